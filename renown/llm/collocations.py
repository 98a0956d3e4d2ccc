"""Phrase collocation mining by Toivonen's sampling algorithm.

Texts (A-Z lower-cased) fall into pieces at ``[.,;:!?\\x0A-\\x0D]`` and these
into words ``[^\\x20\\x09]+``; a phrase is 1 to 4 words in a row within a piece.
All counts are per language.

1. Sample: phrases of a share of the documents (drawn by hash) that reach a
   lowered count there are proposed.
2. Full pass: counts the proposed phrases and their negative border, i.e. all
   words and every phrase whose parts without the last and without the first
   word are both proposed.
3. A frequent phrase that was not proposed is a border failure: the phrases it
   makes possible are counted by another full pass, and so on until no pass
   finds a failure.  A frequent phrase has frequent parts, so none is missed.
4. One more pass reads the frequent phrases as text.  Every document has one of
   ``TAGS`` tags, and the counting passes keep for each phrase a tag of a document
   that holds it; only documents of that tag name the phrase, so its rows do not
   grow with the tasks.  Scores, cuts and the absorption by longer phrases are
   DataFrame code on that table.

Passes 1 to 3 work on hashed phrase keys, summed per task before the shuffle
(a very common phrase is one row a slice).  Which phrases a pass counts is
decided by a membership bitmap of at most 16 MB: its false positives make a
pass count more, never less, so the closure holds whatever its size; a phrase is
let through at all its places or at none, so one pass counts it whole.  Counts
are by key (62 bits beside the number of words) and a check of 16 more bits; two
phrases of one slice with an equal key would be taken for one (about 1e-7 for a
million phrases).  Step 4 has three such bitmaps, and what they let through
beside the frequent phrases meets no count.

Cases: null and empty texts and texts without words have no phrases; a null
language is ``und``, like the language of that name; repeated rows count as
often as they occur; ties in the score go to the smallest cut; languages
without a candidate have no rows; a table without ``doc_id`` is sampled by its
texts alone; extra columns are ignored; an empty table gives no rows.
Sums of counts are exact up to 38 digits before they enter a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from renown.llm.common import in_filter, key_filter, written
from renown.llm.hashing import BASE, BYTE_TABLE, LENGTH_SEED, SLICE_BYTES, WORD_MULT, mix, text_slices

LONGEST = 4
SUPPORT = 30
ABSORB_PERCENT = 80
TOP = 2000
SCALE = 2_000_000
SIZE_BITS = np.uint64(3)  # of a key hold the number of words less one
SAMPLE_SHARE = 8  # one of so many documents
HELD_KEYS = 2_000_000  # keys summed together in a task
HELD_PHRASES = 1 << 16  # phrases of a task written out together
TAGS = 1 << 8  # of documents
TAG_MULT = (0x9E3779B1, 0x85EBCA6B)
CHECK_MULT = WORD_MULT[LONGEST:]

BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
WORD = ~BREAK
WORD[[32, 9]] = False


def piece_slices(batch):
    """(bytes lower-cased, row of each byte range, offsets): slices of bounded
    size; a longer text is cut after a break (a piece stays whole)."""
    for lo, _, b, off in text_slices(batch.column("text")):
        upper = (b >= 65) & (b <= 90)
        b = b + upper.astype(np.uint8) * np.uint8(32)
        if len(b) <= SLICE_BYTES:
            yield lo, b, off
            continue
        at = 0
        while at < len(b):
            end = len(b)
            if end - at > SLICE_BYTES:
                cut = np.flatnonzero(BREAK[b[at:at + SLICE_BYTES]])
                if not len(cut):
                    cut = np.flatnonzero(BREAK[b[at + SLICE_BYTES:]])[:1] + SLICE_BYTES
                end = at + int(cut[-1]) + 1 if len(cut) else end
            yield lo, b[at:end], np.array([0, end - at])
            at = end


def slice_phrases(b: np.ndarray, off: np.ndarray, lang: np.ndarray, longest: int = LONGEST, within=None):
    """(keys, whole, start, end, row): for n = 1 .. longest the key of the phrase
    from every word on and whether it lies within a piece; byte range and
    row of every word.  ``lang`` is a hash a row.  With ``within``, a bitmap of
    keys, (keys, places, ...): only those of phrases in it all whose parts are in it too."""
    word = WORD[b]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edge = off[:-1][off[:-1] < len(b)]
    first[edge] |= word[edge]
    at = np.flatnonzero(word)
    if not len(at):
        return None
    start_in = np.flatnonzero(first[at])
    lens = np.diff(np.append(start_in, len(at)))
    start = at[start_in]
    place = np.arange(len(at)) - np.repeat(start_in, lens)
    power = np.cumprod(np.full(int(lens.max()), BASE, np.uint64))
    h = mix(np.add.reduceat(BYTE_TABLE[b[at]] * power[place], start_in) + lens.astype(np.uint64) * LENGTH_SEED)
    mark = BREAK[b].astype(np.int64)
    np.add.at(mark, edge, 1)
    piece = np.cumsum(mark)[start]
    row = np.searchsorted(off, start, "right") - 1
    own = lang[row]
    keys, whole, n = [], [], len(start)
    if within is not None:
        starts, inside = np.arange(n), None
        for k in range(1, longest + 1):
            if k > 1:  # both parts of a phrase are known ones
                starts = starts[inside[starts + 1]]
                starts = starts[piece[starts] == piece[starts + k - 1]]
            acc = own[starts] + np.uint64(k * int(LENGTH_SEED) % 2**64)
            for j in range(k):
                acc = acc + h[starts + j] * WORD_MULT[j]
            key = (mix(acc) & ~SIZE_BITS) | np.uint64(k - 1)
            known = _member(key, within)
            starts = starts[known]
            keys.append(key[known])
            whole.append(starts)
            inside = np.zeros(n + 1, bool)
            inside[starts] = True
        return keys, whole, start, start + lens, row
    for k in range(1, longest + 1):
        m = max(0, n - k + 1)
        acc = own[:m] + np.uint64(k * int(LENGTH_SEED) % 2**64)
        for j in range(k):
            acc = acc + h[j:j + m] * WORD_MULT[j]
        keys.append((mix(acc) & ~SIZE_BITS) | np.uint64(k - 1))
        whole.append(piece[:m] == piece[k - 1:k - 1 + m])
    return keys, whole, start, start + lens, row


def phrase_checks(words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """16 bits of the phrases of ``size`` words that start at ``starts``, apart
    from their keys; ``words`` are the keys of all words.  A word needs none."""
    acc = np.zeros(len(starts), np.uint64)
    for j in range(size if size > 1 else 0):
        acc += words[starts + j] * CHECK_MULT[j]
    return (acc >> np.uint64(48)).astype(np.uint32)


def _own(docs: DataFrame):
    return [F.col(c).cast("string") for c in ("doc_id", "text") if c in docs.columns]


def _plain(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    tag = F.pmod(F.xxhash64(F.lit("tag"), *_own(docs)), F.lit(TAGS)).cast("int")
    return docs.select(lang.alias("lang"), F.xxhash64(lang).alias("lh"), tag.alias("tag"), F.col("text").cast("string").alias("text"))


def _hashed_lang(batch):
    return mix(batch.column("lh").to_numpy().view(np.uint64))


def key_position(col, bits: int):
    return col.bitwiseAND(bits - 1)


def _member(keys: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    return in_filter(bitmap, (keys & np.uint64(8 * len(bitmap) - 1)).astype(np.int64))


def _border(keys, whole, bitmap):
    """For every phrase of 2 words and more: within a piece, both parts in the bitmap."""
    inside = [None, *(_member(k, bitmap) for k in keys[:-1])]
    return [whole[n] & inside[n][:len(whole[n])] & inside[n][1:len(whole[n]) + 1] for n in range(1, len(keys))]


def _counted(filters):
    """Phrases counted by a pass: all (sample), or those let through by the
    last filter and by none of the earlier ones; words by the first.  ``info`` is
    a phrase's check and, in its last 8 bits, the tag of a document that holds it."""
    def run(batches):
        maps = None if filters is None else [f.value for f in filters]
        held, size = [], 0

        def emit():
            key, info = (np.concatenate(part) for part in zip(*held, strict=True))
            order = np.argsort(key)
            key = key[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            count = np.diff(np.append(first, len(key)))
            return pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(info[order[first]].astype(np.int32)), pa.array(count)], ["key", "info", "c"])

        for batch in batches:
            lang, tags = _hashed_lang(batch), batch.column("tag").to_numpy().astype(np.uint32)
            for lo, b, off in piece_slices(batch):
                found = slice_phrases(b, off, lang[lo:], LONGEST - 1 if maps is None else LONGEST)
                if found is None:
                    continue
                keys, whole, _, _, row = found
                if maps is None:
                    take = whole
                else:
                    later = _border(keys, whole, maps[-1])
                    for earlier in maps[:-1]:
                        later = [x & ~y for x, y in zip(later, _border(keys, whole, earlier), strict=True)]
                    take = [whole[0] if len(maps) == 1 else np.zeros(len(keys[0]), bool), *later]
                own = tags[lo + row]
                for n, (k, t) in enumerate(zip(keys, take, strict=True)):
                    starts = np.flatnonzero(t)
                    held.append((k[starts], phrase_checks(keys[0], starts, n + 1) * np.uint32(TAGS) + own[starts]))
                    size += len(starts)
                if size >= HELD_KEYS:
                    yield emit()
                    held, size = [], 0
        if size:
            yield emit()
    return run


def _counts(docs: DataFrame, filters, least: int) -> DataFrame:
    rows = _plain(docs).select("lh", "tag", "text").mapInArrow(_counted(filters), "key long, info int, c long")
    return (rows.groupBy("key", F.expr(f"info div {TAGS}").cast("int").alias("chk")).agg(F.sum("c").alias("c"), F.min(F.expr(f"info % {TAGS}")).alias("tag"))
            .filter(F.col("c") >= least))


def frequent_keys(docs: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(key, chk, c, tag) of all frequent phrases of 1 to 4 words, by Toivonen's
    passes: key, check, count and the tag of documents that hold the phrase."""
    spark = docs.sparkSession
    sample = docs.filter(F.pmod(F.xxhash64(*_own(docs)), F.lit(SAMPLE_SHARE)) == 0)
    # half the count expected of a phrase at the support, so that few are missed
    proposed = written(_counts(sample, None, max(2, support // (2 * SAMPLE_SHARE))))
    found, filters = None, []
    while True:
        bitmap, _ = key_filter(proposed, "key", proposed.count(), key_position)
        filters.append(spark.sparkContext.broadcast(bitmap))
        new = written(_counts(docs, filters, support))
        found = new if found is None else found.union(new)
        sent = filters[-1]
        bits = 8 * len(bitmap)

        def failures(batches, sent=sent):
            for batch in batches:
                yield batch.filter(pa.array(~_member(batch.column("key").to_numpy().view(np.uint64), sent.value)))

        shorter = found.select("key").filter(F.col("key").bitwiseAND(int(SIZE_BITS)) < LONGEST - 1)
        if shorter.mapInArrow(failures, "key long").isEmpty():
            return found
        # all known frequent phrases; counted ones are told by the earlier filters
        proposed = shorter


def phrase_counts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(lang, size, phrase, c) of the phrases of ``frequent_keys``; size 0 holds
    the number of words of a language.  A phrase is named by the documents of its tag."""
    n_keys, tag = keys.count(), F.col("tag").cast("long")
    owned = keys.select("key", F.col("key").bitwiseXOR(tag * TAG_MULT[0]).alias("first"),
                        F.shiftrightunsigned("key", 32).bitwiseXOR(tag * TAG_MULT[1]).alias("second"))
    sent = docs.sparkSession.sparkContext.broadcast([key_filter(owned, c, n_keys, key_position)[0] for c in owned.columns])

    def run(batches):
        held, totals = {}, {}
        known, first, second = sent.value

        def emit(keys, checks, langs, sizes, phrases, counts):
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(checks, pa.int32()), pa.array(langs, pa.string()), pa.array(sizes, pa.int32()),
                                               pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], ["key", "chk", "lang", "size", "phrase", "c"])

        def named():
            return emit(list(held), *zip(*held.values(), strict=True), [None] * len(held))

        for batch in batches:
            lang, names = _hashed_lang(batch), batch.column("lang").to_pylist()
            tags = batch.column("tag").to_numpy().astype(np.uint64)
            for lo, b, off in piece_slices(batch):
                found = slice_phrases(b, off, lang[lo:], within=known)
                if found is None:
                    continue
                all_keys, places, start, end, row = found
                for r, c in enumerate(np.bincount(row).tolist()):
                    if c:
                        totals[names[lo + r]] = totals.get(names[lo + r], 0) + c
                words, own, text = np.zeros(len(start), np.uint64), tags[lo + row], b.tobytes()
                words[places[0]] = all_keys[0]
                for n, (key, at) in enumerate(zip(all_keys, places, strict=True)):
                    for shift, mult, bitmap in ((0, TAG_MULT[0], first), (32, TAG_MULT[1], second)):
                        mine = _member((key >> np.uint64(shift)) ^ (own[at] * np.uint64(mult)), bitmap)
                        key, at = key[mine], at[mine]
                    key, once = np.unique(key, return_index=True)
                    at = at[once]
                    checks = phrase_checks(words, at, n + 1).tolist()
                    for k, check, w in zip(key.view(np.int64).tolist(), checks, at.tolist(), strict=True):
                        if k not in held:
                            held[k] = check, names[lo + row[w]], n + 1, b" ".join(text[start[w]:end[w + n]].split())
                if len(held) >= HELD_PHRASES:
                    yield named()
                    held = {}
        if held:
            yield named()
        if totals:
            none = [None] * len(totals)
            yield emit(none, none, list(totals), [0] * len(totals), [b""] * len(totals), list(totals.values()))

    rows = _plain(docs).mapInArrow(run, "key long, chk int, lang string, size int, phrase string, c long")
    rows = rows.groupBy("key", "chk", "lang", "size", "phrase").agg(F.sum("c").alias("words"))
    return (rows.join(keys.select("key", "chk", "c"), ["key", "chk"], "left").select("lang", "size", "phrase", F.coalesce("words", "c").alias("c"))
            .filter(F.col("c").isNotNull()))


def _words(first: int, last) -> str:
    return f"array_join(slice(w, {first}, {last}), ' ')"


def collocations(docs: DataFrame, support: int = SUPPORT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best ``top``."""
    counts = written(phrase_counts(docs, frequent_keys(docs, support)).filter((F.col("size") == 0) | (F.col("c") >= support)))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = scored(counts).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    words = counts.filter("size = 0").select("lang", F.col("c").alias("n"))
    return ranked.join(F.broadcast(words) if words.count() <= 10_000 else words, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that no longer one absorbs."""
    single = counts.filter("size > 0").select("lang", "phrase", "c")
    candidates = counts.filter("size > 1").withColumn("w", F.split("phrase", " ", -1))
    # every cut with the counts of its parts
    cuts = candidates.select("lang", "phrase", F.col("c").alias("a"), F.explode(F.expr(
        f"transform(sequence(1, size - 1), k -> struct(k, {_words(1, 'k')} as left, array_join(slice(w, k + 1, size - k), ' ') as right))")).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut.*")
    cuts = cuts.join(single.select("lang", F.col("phrase").alias("left"), F.col("c").alias("l")), ["lang", "left"])
    cuts = cuts.join(single.select("lang", F.col("phrase").alias("right"), F.col("c").alias("r")), ["lang", "right"])
    wide = "decimal(38,0)"
    score = F.expr(f"cast(a as {wide}) * cast({SCALE} as {wide}) div (cast(l as {wide}) + cast(r as {wide}))").cast("long")
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("s"))
    # the most frequent longer candidate around each contiguous part of 2 words and more
    inner = candidates.filter("size > 2").select("lang", F.col("c").alias("longer"), F.explode(F.expr(
        "flatten(transform(sequence(2, size - 1), n -> transform(sequence(1, size - n + 1), i -> array_join(slice(w, i, n), ' '))))")).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = (lowest.join(inner, ["lang", "phrase"], "left")
            .filter(F.col("longer").isNull() | (F.col("longer").cast(wide) * 100 < F.col("a").cast(wide) * ABSORB_PERCENT)))
    return kept.select("lang", "phrase", "a", "s.l", "s.r", "s.score")
