"""Company names: alias resolution, needle sets, mention tests and tagging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renown.functions import lexicons as lx
from renown.functions.text import col_, normalize_spaces, title_case
from renown.plans.strategy import BROADCAST_MAX_ROWS, broadcast_if_small, cut_lineage, row_count_at_most


def first_alias_per_key(aliases: DataFrame) -> DataFrame:
    """alias_lc -> full_name, the first alias (by ord) wins on duplicates."""
    return aliases.groupBy(F.lower("alias").alias("alias_lc")).agg(
        F.min_by("full_name", "ord").alias("full_name"))


def normalize_company(df: DataFrame, name_col: str, aliases: DataFrame, out: str = "company") -> DataFrame:
    """strip + collapse spaces; case-insensitive alias lookup; else title-case."""
    n = df.withColumn("_name", normalize_spaces(name_col)).withColumn("alias_lc", F.lower("_name"))
    res = n.join(first_alias_per_key(aliases), "alias_lc", "left")
    return res.withColumn(out, F.coalesce(F.col("full_name"), title_case("_name"))).drop("_name", "alias_lc", "full_name")


def company_needles(companies: DataFrame, aliases: DataFrame, company_col: str = "company") -> DataFrame:
    """company -> sorted distinct lower-case needles: the name and every alias
    whose full name equals the company (case-insensitive)."""
    al = aliases.groupBy(F.lower("full_name").alias("_k")).agg(F.collect_set(F.lower("alias")).alias("_al"))
    c = companies.select(company_col).distinct().withColumn("_k", F.lower(company_col))
    return c.join(al, "_k", "left").select(
        F.col(company_col),
        F.array_sort(F.array_distinct(F.concat(F.array(F.col("_k")), F.coalesce(F.col("_al"), F.array().cast("array<string>"))))).alias("needles"),
    )


def mentions_any(text, needles, lowered: bool = False) -> Column:
    """Case-insensitive substring test of the text against a needle array
    (``lowered``: the text column is already lower-case)."""
    lt = col_(text) if lowered else F.lower(F.coalesce(col_(text), F.lit("")))
    return F.exists(col_(needles), lambda n: lt.contains(n))


def ends_with_any(url, keys) -> Column:
    """lower(url) ends with any key as written (case-sensitive keys)."""
    lu = F.lower(F.coalesce(col_(url), F.lit("")))
    return F.exists(F.array(*[F.lit(k) for k in keys]), lambda k: lu.endswith(k)) if keys else F.lit(False)


def with_needles(df: DataFrame, needles: DataFrame) -> DataFrame:
    """Attach each row's company needle array (equi-join on company; the
    needle table has one row per company)."""
    return df.join(broadcast_if_small(needles), "company", "left").withColumn(
        "needles", F.coalesce("needles", F.array(F.lower("company"))))


FEW_NEEDLES = 64  # up to so many needles are tested one by one in generated code
GRAM = 3  # letters of an indexed gram
STRIDE = GRAM  # longer needles meet grams cut at every third place only
SAMPLE_SHARE = 64  # one of so many texts tells how common a gram is
# kinds of grams a text is cut into, each prefixed so that kinds never meet:
# 1 and 2 (all places) for needles that short, a (all places) up to
# GRAM + STRIDE - 2 letters, t (every third place) for longer needles
KINDS = ("1", "2", "a", "t")


def _needle_kind(needle="needle") -> Column:
    n = F.length(needle)
    return (F.when(n < GRAM, n.cast("string")).when(n < GRAM + STRIDE - 1, F.lit("a")).otherwise(F.lit("t")))


def _chunks(low: Column, n: int, first: int = 0) -> Column:
    """Consecutive grams of ``n`` letters from letter ``first`` on."""
    return F.regexp_extract_all(F.expr(f"substring(_low, {first + 1})") if first else low, F.lit(f"(?s)(.{{{n}}})"), F.lit(1))


def _text_grams(low: Column, kinds) -> Column:
    """Distinct prefixed grams of the kinds that some needle has."""
    parts = {"1": [_chunks(low, 1)], "2": [_chunks(low, 2, i) for i in range(2)],
             "a": [_chunks(low, GRAM, i) for i in range(GRAM)], "t": [_chunks(low, GRAM)]}
    prefixed = lambda k: lambda g: F.concat(F.lit(k), g)
    grams = [F.transform(c, prefixed(k)) for k in kinds for c in parts[k]]
    return F.array_distinct(F.concat(*grams))


def needle_index(needles: DataFrame, texts: DataFrame, kinds, keys) -> DataFrame:
    """(gram, needle): the grams by which each needle is found.  A needle of
    kind t has one gram for each of the three ways a text's cuts can fall on
    it, others have one; each is the rarest of its choices in a hash sample of
    the texts (the choice only decides how many candidates are compared)."""
    sample = texts.where(F.pmod(F.xxhash64(*keys), F.lit(SAMPLE_SHARE)) == 0)
    common = sample.select(F.explode(_text_grams(F.col("_low"), kinds)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    size = F.when(F.col("kind").isin("1", "2"), F.length("needle")).otherwise(F.lit(GRAM))
    n = needles.select("needle").distinct().withColumn("kind", _needle_kind()).withColumn("size", size)
    n = n.withColumn("at", F.explode(F.expr("sequence(1, length(needle) - size + 1)")))
    n = n.select("needle", F.when(F.col("kind") == "t", F.col("at") % STRIDE).otherwise(F.lit(0)).alias("way"),
                 F.concat("kind", F.expr("substring(needle, at, size)")).alias("gram"))
    n = n.join(common, "gram", "left").groupBy("needle", "way").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("best"))
    return n.select(F.col("best.gram").alias("gram"), "needle").distinct()


def tag_companies(texts: DataFrame, needles: DataFrame, text_col: str = "raw_text", key_cols=("seq",),
                  max_broadcast: int = BROADCAST_MAX_ROWS, few: int = FEW_NEEDLES) -> DataFrame:
    """Theta join text x needle on substring containment -> (key, company).

    At most ``few`` needles are tested in generated code, like a lexicon.
    More go through an inverted index instead of one test per needle: every
    text is cut once into grams, which meet the grams of the needles in an equi-join;
    ``contains`` decides the few candidates.  An index of at most
    ``max_broadcast`` entries is broadcast, so texts never leave their tasks;
    a larger one is joined on slim (key, gram) rows, hot grams split by AQE,
    and candidates meet their texts by key.  Exact for any number of needles.
    """
    keys = list(key_cols)
    long = needles.select("company", F.explode("needles").alias("needle")).where(F.length("needle") > 0).distinct()
    if row_count_at_most(long.select("needle").distinct(), few):
        words = sorted(r[0] for r in long.select("needle").distinct().collect())  # at most ``few``
        if not words:
            return texts.select(*keys, F.lit(None).cast("string").alias("company")).limit(0)
        low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
        none = F.array().cast("array<string>")
        found = texts.select(*keys, F.explode(F.concat(*[F.when(low.contains(w), F.array(F.lit(w))).otherwise(none) for w in words])).alias("needle"))
        return found.join(broadcast_if_small(long), "needle").select(*keys, "company").distinct()
    present = {r[0] for r in long.select(_needle_kind()).distinct().collect()}  # at most four kinds
    kinds = [k for k in KINDS if k in present]
    low = texts.select(*keys, F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_low"))
    index = cut_lineage(needle_index(long, low, kinds, keys))
    grams = low.select(*keys, "_low", F.explode(_text_grams(F.col("_low"), kinds)).alias("gram"))
    if row_count_at_most(index, max_broadcast) and row_count_at_most(long, max_broadcast):
        hits = grams.join(F.broadcast(index), "gram").where(F.col("_low").contains(F.col("needle"))).select(*keys, "needle")
        return hits.join(F.broadcast(long), "needle").select(*keys, "company").distinct()
    pairs = grams.drop("_low").join(index, "gram").select(*keys, "needle").distinct()
    hits = pairs.join(low, keys).where(F.col("_low").contains(F.col("needle"))).select(*keys, "needle")
    return hits.join(long, "needle").select(*keys, "company").distinct()


def enrich_query(company, platform) -> Column:
    """Per-platform search query text."""
    p = F.lower(col_(platform))
    c = col_(company)
    expr = None
    for plat, tpl in lx.QUERY_TEMPLATES.items():
        pre, _, post = tpl.partition("{c}")
        v = F.concat(F.lit(pre), c, F.lit(post))
        expr = F.when(p == plat, v) if expr is None else expr.when(p == plat, v)
    pre, _, post = lx.QUERY_TEMPLATE_DEFAULT.partition("{c}")
    return expr.otherwise(F.concat(F.lit(pre), c, F.lit(post)))


def enriched_queries(companies: DataFrame, platforms=None) -> DataFrame:
    """Company x platform grid (the platform list is fixed and tiny, so the
    cross product is with a literal array, not a join)."""
    platforms = platforms or lx.PLATFORMS
    arr = F.array(*[F.struct(F.lit(i).alias("platform_ord"), F.lit(p).alias("platform")) for i, p in enumerate(platforms)])
    g = companies.select("company").distinct().select("company", F.inline(arr))
    return g.withColumn("query", enrich_query("company", "platform"))


def read_alias_json(spark, path: str) -> DataFrame:
    """Load an alias object file {alias: full_name} into (ord, alias, full_name);
    an unreadable or malformed file gives an empty dimension."""
    schema = "ord int, alias string, full_name string"
    try:
        raw = spark.read.text(path, wholetext=True)
        m = raw.select(F.from_json("value", "map<string,string>").alias("m"))
        # map_entries keeps the key order of the object text
        out = m.select(F.posexplode(F.map_entries("m")).alias("ord", "e")).select(
            F.col("ord").cast("int"), F.col("e.key").alias("alias"), F.col("e.value").alias("full_name"))
        return out.where(F.col("alias").isNotNull())
    except Exception:
        return spark.createDataFrame([], schema)
