"""Secret scans: three base patterns plus password guess-cost scoring.

Base kinds are found leftmost and without overlap, each kind on its own:
``assign`` (credential assignments with a value of 6+ characters), ``access``
(AKIA keys of 20+ characters) and ``hex`` (24+ lower-case hex digits); the
span is the whole match.  The method adds ``guess`` spans: values in a
credential context (wider than ``assign``) whose cheapest segmentation into
dictionary words, dates, repeats, keyboard walks, sequences and brute-force
spans still costs at least 10 ** ``MIN_GUESSES`` guesses.  The segmentation
is a dynamic program over the whole value, so its cost is the minimum over
all segmentations; a value's time is linear in its length.

Dictionary words are a short list of password words and, of the letter runs
of values in a credential context (their parts of 3 to ``MAX_LETTERS`` letters
and whole runs of any length), those that the corpus uses as words.  All of them
are counted over all texts, none is capped: a word that stands in n of the N rows
of the table has rank ceil(N / n), what Zipf's law gives for its frequency, so a
table loaded k times over ranks alike.  An occurrence counts where another word
stands beside it (one space, or comma and space, between); values in a
credential context, and passwords that stand alone, make no dictionary word.
So prose after a credential word ("the password is required.") is no secret.
Ranks reach their rows by joins on the row key; only rows with such words are
shuffled, and nothing per word or row goes to the driver.

Cases: null text is empty and has no spans; equal rows are scanned alike;
any text length is handled in one row; extra columns are ignored; empty
tables give empty results; a null doc_id is kept as null.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from renown.llm.common import in_filter, key_filter, marked_rows, names, quoted, row_keys, scratch, written

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a maximal run, so shorter ones fail as a whole
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
CONTEXT = re.compile(
    r"""(?:password|passwd|passphrase|passcode|passwort|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key|credentials?|login)"""
    r"""["']?\s{0,3}(?:is\s|[:=]{1,2}>?)\s{0,3}["']?([^\s"'<>]{6,})""", re.IGNORECASE | re.ASCII)
CONTEXT_HINTS = (*ASSIGN_HINTS, "passphrase", "passcode", "pwd", "key", "credential", "login")
MIN_GUESSES = 9.0
KINDS = ("assign", "access", "hex", "guess")
BATCH = 256
MIN_LETTERS, MAX_LETTERS = 3, 24
LETTERS = re.compile(r"[^\W\d_]+")
# a word beside another word; possessive, so a long run of letters is passed once
BESIDE = r"(?<!\p{L})(?:(?<=\p{L},? )\p{L}++|\p{L}++(?=,? \p{L}))"
FLUSH = 1 << 16  # candidate words a batch
SPARSE = 32  # times the usual bits of a key filter: 1,024 a word, up to its bound

# fixed values: common password words (by rank) and keyboard rows
WORDS = """password welcome login admin master dragon monkey letmein secret shadow sunshine princess football baseball
superman batman hello freedom whatever trustno hunter summer winter spring autumn flower cheese coffee computer internet
server system default changeme example sample test guest user root access token qwerty love star angel soccer hockey
killer pepper ginger jordan michael daniel thomas robert charlie andrew matthew jessica ashley nicole orange banana
purple yellow silver golden diamond black white green blue magic music family mother father friend london berlin paris
madrid january february march april june july august september october november december monday friday sunday""".split()
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "azertyuiop")
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
LONGEST = max(map(len, WORDS))
LEET = str.maketrans("4301$57@!", "aeolsstai")
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")
DATE_COST = {4: math.log10(120), 8: math.log10(120 * 366), 9: math.log10(120 * 366 * 4), 10: math.log10(120 * 366 * 4)}


def _neighbours() -> dict[str, set[str]]:
    near: dict[str, set[str]] = {}
    for row in KEY_ROWS:
        for a, b in zip(row, row[1:], strict=False):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    return near


NEAR = _neighbours()


def _alphabet(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100)


def _runs(s: str, steps) -> list[int]:
    """For every position the length of the longest run from it in which
    ``steps`` holds between neighbours."""
    out = [1] * len(s)
    for i in range(len(s) - 2, -1, -1):
        if steps(s[i], s[i + 1]):
            out[i] = out[i + 1] + 1
    return out


def guess_cost(value: str, ranks: dict[str, int] | None = None) -> float:
    """log10 of the guesses of the cheapest segmentation of ``value``, words
    by their ranks (those of ``WORDS`` when none are given)."""
    ranks, longest = (RANK, LONGEST) if ranks is None else (ranks, max(LONGEST, MAX_LETTERS))
    n, low = len(value), value.lower()
    plain = low.translate(LEET)
    dates: dict[int, list[tuple[int, float]]] = {}
    for i in range(n):
        if low[i].isdigit() and (m := DATE.match(low, i)):
            dates.setdefault(i, []).append((m.end(), DATE_COST.get(m.end() - i, DATE_COST[10])))
            if m.end() - i > 4 and low[i:i + 2] in ("19", "20"):
                dates[i].append((i + 4, DATE_COST[4]))
    same = _runs(low, lambda a, b: a == b)
    walk = _runs(low, lambda a, b: b in NEAR.get(a, ()))
    up = _runs(low, lambda a, b: a.isalnum() and ord(b) - ord(a) == 1)
    down = _runs(low, lambda a, b: a.isalnum() and ord(b) - ord(a) == -1)
    # a block of each length and its repeats: how far the value equals itself moved by that length
    equal = {unit: [0] * (n + 1) for unit in range(2, 9)}
    for unit, run in equal.items():
        for i in range(n - unit - 1, -1, -1):
            run[i] = run[i + 1] + 1 if low[i] == low[i + unit] else 0
    best = [0.0] + [math.inf] * n
    segment = math.log10(2)  # guesses to know where the next segment starts
    runs_over = {m.start(): m.end() for m in LETTERS.finditer(low) if m.end() - m.start() > longest}
    for i in range(n):
        here = best[i]
        best[i + 1] = min(best[i + 1], here + _alphabet(value[i]))
        here += segment
        for j in (*range(i + MIN_LETTERS, min(n, i + longest) + 1), *((runs_over[i],) if i in runs_over else ())):
            rank = ranks.get(low[i:j]) or ranks.get(plain[i:j])
            if rank:
                cost = math.log10(rank) + (0 if value[i:j] == low[i:j] else math.log10(4)) + (0 if low[i:j] in ranks else math.log10(4))
                best[j] = min(best[j], here + cost)
        for j, cost in dates.get(i, ()):
            best[j] = min(best[j], here + cost)
        if same[i] >= 3:
            best[i + same[i]] = min(best[i + same[i]], here + _alphabet(low[i]) + math.log10(same[i]))
        for runs, choices in ((walk, 40 * 4), (up, 40), (down, 80)):
            if runs[i] >= 3:
                best[i + runs[i]] = min(best[i + runs[i]], here + math.log10(choices * runs[i]))
        for unit, run in equal.items():
            times = 1 + run[i] // unit
            if times > 1:
                cost = sum(map(_alphabet, low[i:i + unit])) + math.log10(times)
                best[i + unit * times] = min(best[i + unit * times], here + cost)
    return best[n]


class _EveryWord:
    """Ranks under which every run of letters is the likeliest word there is:
    the cost under them is a lower bound for any corpus."""

    def get(self, word: str) -> int | None:
        return 1 if word.isalpha() else None

    def __contains__(self, word: str) -> bool:
        return word.isalpha()


EVERY_WORD = _EveryWord()


def candidate_words(value: str):
    """The parts of a value that a dictionary word could cover, as ``guess_cost`` looks them up."""
    low = value.lower()
    for form in {low, low.translate(LEET)}:
        for run in LETTERS.findall(form):
            for i in range(len(run) - MIN_LETTERS + 1):
                yield from (run[i:j] for j in range(i + MIN_LETTERS, min(len(run), i + MAX_LETTERS) + 1))
            if len(run) > MAX_LETTERS:
                yield run


def _hinted(text):
    low, out = F.lower(text), F.lit(False)
    for hint in CONTEXT_HINTS:
        out = out | low.contains(hint)
    return out


def _candidates(docs: DataFrame, min_guesses: float) -> DataFrame:
    """(k1, k2, word) of every value in a credential context whose words decide:
    a secret without the corpus, and none if all its letter runs were the most
    frequent words.  Rows may repeat."""
    def run(batches):
        for batch in batches:
            rows = []
            for k1, k2, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                keys = k1.as_py(), k2.as_py()
                for value in {m[1] for m in CONTEXT.finditer(text.as_py())}:
                    if guess_cost(value) < min_guesses or guess_cost(value, EVERY_WORD) >= min_guesses:
                        continue
                    for word in candidate_words(value):
                        rows.append((*keys, word))
                        if len(rows) == FLUSH:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["k1", "k2", "word"])
                            rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["k1", "k2", "word"])

    k1, k2 = row_keys(docs)
    text = F.col("text").cast("string")
    return docs.select(k1.alias("k1"), k2.alias("k2"), text.alias("text")).filter(_hinted(F.col("text"))).mapInArrow(run, "k1 long, k2 long, word string")


def word_counts(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(word, n): rows in which a word of ``words`` (one column, distinct)
    stands beside another word, outside of values in a credential context.
    Words are told by a bitmap of their hashes and counted where the texts lie:
    a task makes a row a word it has, not one an occurrence.  The last join drops
    what the bitmap lets through beside the words."""
    text = F.col("text").cast("string")
    rest = F.lower(F.when(_hinted(text), F.regexp_replace(text, "(?i)" + CONTEXT.pattern, "\n")).otherwise(text))
    found = docs.select(F.array_distinct(F.regexp_extract_all(rest, F.lit(BESIDE), F.lit(0))).alias("words"))
    bitmap, bits = key_filter(words.select(F.xxhash64("word").alias("key")), "key", SPARSE * words.count(), lambda col, bits: col.bitwiseAND(bits - 1))
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        held: Counter[str] = Counter()

        def emit():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            keys = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            known = batch.column(0).flatten().filter(pa.array(in_filter(sent.value, keys & (bits - 1))))
            for lo in range(0, len(known), FLUSH):
                for pair in known.slice(lo, FLUSH).value_counts().to_pylist():
                    held[pair["values"]] += pair["counts"]
                if len(held) >= FLUSH:
                    yield emit()
                    held.clear()
        if held:
            yield emit()

    rows = found.select("words", F.transform("words", lambda w: F.xxhash64(w)).alias("keys")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).join(words, "word", "left_semi")


def word_ranks(docs: DataFrame, min_guesses: float = MIN_GUESSES) -> DataFrame:
    """(k1, k2, ranks): of every row whose credential values hold words of the
    corpus, its two row keys and the ranks of these words (a map)."""
    with scratch(docs.sparkSession) as keep:
        found = written(_candidates(docs, min_guesses).distinct())
        counts = word_counts(docs, found.select("word").distinct())
        rows = docs.count()
        ranked = found.join(counts, "word").groupBy("k1", "k2").agg(
            F.map_from_entries(F.collect_list(F.struct("word", F.ceil(F.lit(rows) / F.col("n")).cast("long")))).alias("ranks"))
        return keep(written(ranked))


def _with_ranks(docs: DataFrame, min_guesses: float) -> DataFrame:
    """The columns of ``docs`` and, last, the ranks of the words in the row's credential values (null: none)."""
    k1, k2, ranks = (names(docs, p)[0] for p in ("k1", "k2", "ranks"))
    known = word_ranks(docs, min_guesses).toDF(k1, k2, ranks)
    first, second = row_keys(docs)
    marked, rest = marked_rows(docs.withColumns({k1: first, k2: second}), known, k1, k2)
    columns = quoted(docs.columns)
    return marked.join(known, [k1, k2], "left").select(*columns, ranks).union(rest.select(*columns, F.lit(None).cast("map<string,bigint>").alias(ranks)))


def _merged(ranks) -> dict[str, int] | None:
    """Ranks of a row's words with those of ``WORDS``, the lower one each."""
    if not ranks:
        return None
    ranks = dict(ranks)
    return ranks | {w: min(i, ranks.get(w, i)) for w, i in RANK.items()}


def find_spans(text: str | None, min_guesses: float = MIN_GUESSES, ranks: dict[str, int] | None = None) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) of a text by start, then kind as listed."""
    if not text:
        return []
    out, low = [], text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if any(h in low for h in CONTEXT_HINTS):
        out += [(*m.span(1), "guess") for m in CONTEXT.finditer(text) if guess_cost(m[1], ranks) >= min_guesses]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def redacted(text: str | None, mark: str = "[SECRET]", min_guesses: float = MIN_GUESSES, ranks: dict[str, int] | None = None) -> str | None:
    """The text with every maximal run of overlapping spans replaced by ``mark``."""
    spans = find_spans(text, min_guesses, ranks)
    if not spans:
        return text
    out, done, i = [], 0, 0
    while i < len(spans):
        lo, hi = spans[i][:2]
        while i + 1 < len(spans) and spans[i + 1][0] < hi:
            i += 1
            hi = max(hi, spans[i][1])
        out += [text[done:lo], mark]
        done, i = hi, i + 1
    return "".join(out) + text[done:]


def secret_spans(docs: DataFrame, min_guesses: float = MIN_GUESSES) -> DataFrame:
    """Per input row: doc_id and spans, an array of (start, end, kind)."""
    schema = "doc_id long, spans array<struct<start:long, end:long, kind:string>>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                found = [[{"start": s, "end": e, "kind": k} for s, e, k in find_spans(t.as_py(), min_guesses, _merged(r.as_py()))]
                         for t, r in zip(part.column(1), part.column(2), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _with_ranks(slim, min_guesses).mapInArrow(run, schema)


def redact(docs: DataFrame, mark: str = "[SECRET]", min_guesses: float = MIN_GUESSES) -> DataFrame:
    """The documents with their secrets replaced; other columns unchanged."""
    at, last = docs.columns.index("text"), len(docs.columns)
    plain = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(docs.schema)])  # names with dots fail in mapInArrow

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                clean = pa.array([redacted(t.as_py(), mark, min_guesses, _merged(r.as_py()))
                                  for t, r in zip(part.column(at), part.column(last), strict=True)], pa.string())
                yield part.set_column(at, part.schema.field(at), clean).select(range(last))

    return _with_ranks(docs, min_guesses).toDF(*plain.names, "ranks").mapInArrow(run, plain).toDF(*docs.columns)


def span_digest(spans: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (text)."""
    listed = lambda of: F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return spans.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
                        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def hash_of(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans if k != "guess").encode()).hexdigest()
