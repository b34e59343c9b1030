"""SpotSigs fingerprints: chains of content words after common-word anchors, compared by length-partitioned Jaccard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.storage import materialise

#: The anchors, common words of four languages.
ANCHORS = {
    "en": "a an and are as at be been but by can do for from had has have he her his in is it its not of on or she that the their they this to was were which will with you",
    "de": "aber als am an auch auf aus bei das dem den der des die ein eine einer er es für hat im in ist mit nicht noch sich sie sind und von war wie zu zum zur",
    "fr": "au aux avec ce cette dans de des du elle en est et il ils la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une",
    "es": "al como con de del el ella en es esta este fue ha la las lo los más no para pero por que se ser si sin su sus un una y",
}
WORDS = tuple(sorted({w for words in ANCHORS.values() for w in words.split()}))
#: Content words in a chain; quantiles by which rows are put in order, rows of a bucket between them, and rows of a task.
CHAIN, PROBES, ROWS, TASK_ROWS = 2, 64, 250, 5000
_MARK = "\x02"


def _branches(words: list[str]) -> str:
    """A pattern of the words, grouped by their first letters, so that a text's word is tried against few of them."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    parts = [h + (_branches(rest) if len(rest) > 1 else rest[0]) for h, rest in heads.items() if h]
    return f"(?:{'|'.join(parts)}){'?' if '' in heads else ''}"


def with_signatures(df: DataFrame, text: Column, out: str, chain: int = CHAIN) -> DataFrame:
    """df with the ascending distinct hashes (array<long>) of a text's chains; null counts as empty.

    Words are runs of letters and digits, in lower case. A chain is an anchor and the next content words after it, other
    anchors between them left out. A text without a chain has its content words for signatures, and without those its
    words; no word, no signature. The steps are columns of their own, so that none is computed twice. A column out of df's is replaced;
    raises ValueError where df has a column __marked or __found.
    """
    _free(df, "__marked", "__found")
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    # Each anchor becomes a mark and itself; no mark is a letter or a digit.
    marked = F.regexp_replace(F.concat(F.lit(" "), F.trim(plain), F.lit(" ")), rf" (?={_branches(list(WORDS))} )", f" {_MARK}")
    content = rf" (?:{_MARK}[^ ]+ )*+[^ {_MARK}]+"
    found = F.regexp_extract_all(F.col("__marked"), F.lit(rf"{_MARK}[^ ]+(?=((?:{content}){{{chain}}}) )"), F.lit(1))
    chains = F.transform("__found", lambda s: F.xxhash64(F.regexp_replace(s, rf" (?:{_MARK}[^ ]+ )*+", " ")))
    words = F.filter(F.split(F.trim("__marked"), " "), lambda w: w != "")
    lone = F.filter(words, lambda w: ~w.startswith(_MARK))
    other = F.transform(F.when(F.size(lone) > 0, lone).otherwise(words), lambda w: F.xxhash64(F.translate(w, _MARK, "")))
    made = df.withColumn("__marked", marked).withColumn("__found", found)
    return made.withColumn(out, F.array_sort(F.array_distinct(F.when(F.size("__found") > 0, chains).otherwise(other)))).drop("__marked", "__found")


def _free(df: DataFrame, *names: str) -> None:
    if taken := sorted({*names} & {*df.columns}):
        raise ValueError(f"columns {taken} are taken")


def fingerprint(signature_set: Column) -> Column:
    """A string for a set: its length, by which sets are partitioned, and a digest of its signatures."""
    return F.concat(F.size(signature_set).cast("string"), F.lit("-"), F.md5(F.array_join(F.transform(signature_set, lambda x: F.hex(x)), ",")))


def likeness(a: Column, b: Column) -> Column:
    """The sets' Jaccard similarity; two empty sets are alike, an empty and another are not."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def _bucket(df: DataFrame, id_col: str) -> tuple[Column, int]:
    """A number that rises with the id and holds about ROWS rows each, and the rows in all.

    The number is the id's place among PROBES quantiles, and between two of them in proportion. Null ids come last.
    """
    probes = [i / PROBES for i in range(PROBES + 1)]
    rows, n, bounds = df.agg(F.count("*"), F.count(id_col), F.percentile_approx(F.col(id_col), probes, 10_000)).first()
    bounds = sorted(set(bounds or [0]))
    parts = max(1, -(-n // (len(bounds) * ROWS)))
    edges = F.array(*map(F.lit, bounds))
    place = F.size(F.filter(edges, lambda b: b <= F.col(id_col)))
    low, high = F.get(edges, place - 1).cast("double"), F.get(edges, place).cast("double")
    within = F.coalesce(F.floor((F.col(id_col).cast("double") - low) / (high - low) * parts), F.lit(0))
    return F.when(F.col(id_col).isNull(), F.lit((len(bounds) + 1) * parts)).otherwise(place * parts + F.least(F.lit(parts - 1), within)).cast("long"), rows


def with_next(df: DataFrame, id_col: str, text_col: str, out: str, sigs: str | None = None) -> DataFrame:
    """df with the text of the next row by id (a long) in out; the last row has the first's. Null ids come last, and rows of one id go by text.

    With sigs, that column has the signatures of a row's text and out + "_sigs" those of the next; each row's are made once.
    Raises ValueError where df has a column of one of the new names, or __b, __last, __first or __head_*.
    Rows are dealt out once, in buckets that rise with the id, to as many tasks as there are times TASK_ROWS rows. Each bucket
    finds its rows' successors; its last row takes the first of the next bucket that has any. Those first rows are found by
    their ids, which are one a bucket.
    """
    carried = {out: text_col} | ({f"{out}_sigs": sigs} if sigs else {})
    _free(df, "__b", "__last", "__first", "__next", *carried, *(f"__head_{k}" for k in carried), *[sigs] * bool(sigs))
    bucket, rows = _bucket(df, id_col)
    numbered = df.withColumn("__b", bucket)
    made = (lambda d: with_signatures(d, F.col(text_col), sigs)) if sigs else (lambda d: d)
    dealt = made(numbered.repartition(max(1, -(-rows // TASK_ROWS)), "__b"))
    order = W.partitionBy("__b").orderBy(F.col(id_col).asc_nulls_last(), text_col)
    followed = dealt.withColumns({k: F.lead(v).over(order) for k, v in carried.items()} | {"__last": F.lead(F.lit(True)).over(order).isNull()})
    firsts = numbered.groupBy("__b").agg(F.min(id_col).alias("__first"))
    few = firsts.count() <= 100_000
    known = firsts.where("__first is not null").select("__first")
    heads = numbered.join(F.broadcast(known) if few else known, F.col(id_col) == F.col("__first")).groupBy("__b").agg(F.min(text_col).alias(text_col))
    nulls = numbered.where(F.col(id_col).isNull()).agg(F.max("__b").alias("__b"), F.min(text_col).alias(text_col)).where("__b is not null")
    heads = made(heads.union(nulls))
    ring = W.orderBy("__b")
    after = firsts.select("__b", F.coalesce(F.lead("__b").over(ring), F.first("__b").over(ring)).alias("__next"))
    turn = after.join(heads.select(F.col("__b").alias("__next"), *(F.col(v).alias(f"__head_{k}") for k, v in carried.items())), "__next").drop("__next")
    full = followed.join(turn, "__b")
    ends = {k: F.when(F.col("__last"), F.col(f"__head_{k}")).otherwise(F.col(k)) for k in carried}
    return full.withColumns(ends).drop("__b", "__last", *(f"__head_{k}" for k in carried))


def near_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Links between classes of equal fingerprints, and each document's class.

    Returns (class_a, class_b, similarity), class_a < class_b, for each two classes of Jaccard similarity at threshold or more,
    and (doc_id, class_id), where class_id is the least id with the same set; a null id is never the least.
    Sets are partitioned by length: a set meets only lengths of threshold to 1 / threshold times its own. Within those, two sets
    at the threshold share one of their rarest len - ceil(threshold * len) + 1 signatures, so only these are matched; a
    position bound prunes what is left before the exact comparison. Empty sets form a class without links.
    """
    sets = materialise(with_signatures(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), F.col("text"), "sigs").drop("text"))
    named = sets.withColumn("fingerprint", fingerprint(F.col("sigs")))
    classes = materialise(named.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"), F.first("sigs").alias("sigs")))
    rarity = classes.select("fingerprint", F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count("*").alias("n"))
    ranked = classes.select("fingerprint", F.size("sigs").alias("size"), F.explode("sigs").alias("sig")).join(rarity, "sig")
    ordered = ranked.groupBy("fingerprint", "size").agg(F.array_sort(F.collect_list(F.struct("n", "sig"))).alias("all"))
    kept = F.col("size") - F.ceil(F.col("size") * F.lit(threshold)).cast("int") + 1
    step = F.log(F.lit(1 / threshold))
    band = lambda x: F.floor(F.log(x) / step + F.lit(1e-9)).cast("int")
    prefix = ordered.where("size > 0").select("fingerprint", "size", band(F.col("size")).alias("band"), F.posexplode(F.slice("all", F.lit(1), kept)).alias("pos", "x")).where("x.n > 1").select("fingerprint", "size", "band", "pos", F.col("x.sig").alias("sig"))
    left = prefix.select(F.col("fingerprint").alias("fa"), F.col("size").alias("sa"), F.col("pos").alias("pa"), "sig", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"), F.col("band").alias("ba"))
    right = prefix.select(F.col("fingerprint").alias("fb"), F.col("size").alias("sb"), F.col("pos").alias("pb"), "sig", "band")
    need = F.ceil((F.col("sa") + F.col("sb")) * F.lit(threshold / (1 + threshold)) - F.lit(1e-9))
    bound = F.least(F.col("sa") - F.col("pa"), F.col("sb") - F.col("pb"))
    ahead = (F.col("sa") < F.col("sb")) | ((F.col("sa") == F.col("sb")) & (F.col("fa") < F.col("fb")))
    pairs = left.join(right, ["sig", "band"]).where(ahead & (F.col("sb") * F.lit(threshold) <= F.col("sa"))).groupBy("fa", "fb", "sa", "sb").agg(F.min("pa").alias("pa"), F.min("pb").alias("pb")).where(bound >= need)
    a, b = (classes.select(F.col("fingerprint").alias(f"f{k}"), F.col("class_id").alias(f"c{k}"), F.col("sigs").alias(f"g{k}")) for k in "ab")
    scored = pairs.join(a, "fa").join(b, "fb").withColumn("similarity", likeness(F.col("ga"), F.col("gb"))).where(F.col("similarity") >= threshold)
    return scored.select(F.least("ca", "cb").alias("class_a"), F.greatest("ca", "cb").alias("class_b"), "similarity"), named.join(classes.select("fingerprint", "class_id"), "fingerprint").select("doc_id", "class_id")
