"""Secret scans: pattern spans, and corpus-wide ownership of candidate values.

Candidates of all documents are counted by the distinct repositories and owners that hold them.
A value that many owners hold is a copied example; one that a single owner holds looks live.
"""

from pyspark.sql import Window, functions as F

from itemscope.session import written

#: The base patterns, in the order in which kinds are listed.
ASSIGN = (r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
          r"([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
#: A value without a keyword beside it: long, and of mixed characters.
OPAQUE = r"[A-Za-z0-9+/_-]{24,}={0,2}"
KINDS = ("assign", "access", "hex", "opaque")
#: Owners from which on a value counts as a copied example.
COPIED_OWNERS = 3


_FOUND = "array<struct<kind:int,place:int,gap:int,size:int,long:int,hash:binary>>"


def _matches(text, pattern, kind, values=None):
    """The leftmost matches of a text in order: kind, place, gap, size, long and hash of each.

    The text between matches comes from a split by the same pattern; `gap` is its length before the
    match, in code points. Only the length and a hash of a value leave the expression.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if values is None else values
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    zipped = F.arrays_zip(gaps.alias("gap"), found.alias("match"), values.alias("value"))
    return F.transform(zipped, lambda at, place: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), place.alias("place"), F.length(at["gap"]).alias("gap"),
        F.length(at["match"]).alias("size"), F.length(at["value"]).alias("long"),
        F.unhex(F.sha2(at["value"], 256)).alias("hash")))


def _candidates(text):
    """All matches of a text, those of the base patterns and the opaque values."""
    none = F.array().cast(_FOUND)
    lowered = F.lower(text)
    keyed = F.lit(False)
    for word in KEYWORDS:
        keyed = keyed | lowered.contains(word)
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assign = F.when(keyed, _matches(text, ASSIGN, "assign", values)).otherwise(none)
    access = F.when(text.contains("AKIA"), _matches(text, ACCESS, "access")).otherwise(none)
    hexes = F.when(text.rlike(HEX), _matches(text, HEX, "hex")).otherwise(none)
    mixed = r"[A-Za-z0-9+/_-]{24}"
    opaque = F.when(text.rlike(mixed), _opaque(text)).otherwise(none)
    return F.concat(assign, access, hexes, opaque)


def _opaque(text):
    found = F.regexp_extract_all(text, F.lit(OPAQUE), F.lit(0))
    # Values without a capital, a small letter and two digits are marked by an empty value.
    looks = F.transform(found, lambda v: F.when(
        v.rlike("[A-Z]") & v.rlike("[a-z]") & v.rlike("[0-9].*[0-9]"), v).otherwise(F.lit("")))
    return _matches(text, OPAQUE, "opaque", looks)


def _spans(rows):
    """Rows (row, owner, kind, start, end, hash): the candidate spans of all rows, in code points.

    A match ends where the gaps and matches up to it end, a running sum over its row and kind.
    """
    every = rows.where(F.size("found") > 0).select("row", "owner", F.inline("found"))
    until = Window.partitionBy("row", "kind").orderBy("place").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    every = every.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(until))
    least = F.when(F.col("kind") == KINDS.index("assign"), 6).otherwise(1)
    return every.where(F.col("long") >= least).select(
        "row", "owner", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "hash")


def _outside_base(spans):
    """`spans` with `free`: whether no base span of the row overlaps the span.

    Of the spans that start no later, the furthest end of a base span decides; of those that start
    later, the first start of one.
    """
    base = F.col("kind") < KINDS.index("opaque")
    forth = Window.partitionBy("row").orderBy("start", "kind", "end").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    back = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind"), F.desc("end")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return spans.withColumn("reached", F.max(F.when(base, F.col("end"))).over(forth)).withColumn(
        "next", F.min(F.when(base, F.col("start"))).over(back)).withColumn(
        "free", ~(F.coalesce(F.col("reached") > F.col("start"), F.lit(False))
                  | F.coalesce(F.col("next") < F.col("end"), F.lit(False)))).drop("reached", "next")


def ownership(spans, owner="owner"):
    """Each value's hash with the number of distinct repositories (rows) and owners that hold it."""
    return spans.select("hash", owner, "row").distinct().groupBy("hash", owner) \
        .agg(F.count("*").alias("rows")).groupBy("hash") \
        .agg(F.sum("rows").alias("repositories"), F.count("*").alias("owners"))


def secret_spans(docs, owner="source", copied_owners=COPIED_OWNERS):
    """Spans and counts of secrets in every row.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied. A repository
    is a row of `docs`, its owner the column `owner` (NULL is an owner of its own). Base spans
    always stay. Opaque values are added where no base span overlaps them and fewer than
    `copied_owners` owners hold them. n_live and n_copied count a row's spans by that same
    separation. NULL counts as the empty text, which has no spans; rows that repeat a doc_id have
    results of their own; an empty table gives no rows; further columns are dropped. Whole texts
    are searched, in the JVM.
    """
    rows = written(docs.select(
        "doc_id", F.monotonically_increasing_id().alias("row"), F.col(owner).alias("owner"),
        _candidates(F.coalesce(F.col("text"), F.lit(""))).alias("found")), "secret-rows")
    single = written(_spans(rows), "secret-spans")
    owned = single.join(ownership(single), "hash").withColumn(
        "copied", F.col("owners") >= copied_owners)
    opaque = KINDS.index("opaque")
    kept = _outside_base(owned.select("row", "kind", "start", "end", "copied")).where(
        (F.col("kind") < opaque) | (F.col("free") & ~F.col("copied")))
    decided = kept.groupBy("row").agg(F.array_sort(F.collect_list(
        F.struct("start", "kind", "end", "copied"))).alias("kept"))
    joined = rows.drop("found", "owner").join(decided, "row", "left").withColumn(
        "kept", F.coalesce("kept", F.array().cast(
            "array<struct<start:bigint,kind:int,end:bigint,copied:boolean>>")))
    joined = joined.withColumn("base", F.filter("kept", lambda s: s["kind"] < opaque))

    def listed(column):
        names = F.array(*map(F.lit, KINDS))
        return F.array_join(F.transform(column, lambda s: F.concat_ws(
            ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"),
            s["end"].cast("string"))), ",")

    def count(column, test):
        return F.size(F.filter(column, test)).cast("long")

    def of_kind(kind):
        return lambda s: s["kind"] == kind

    return joined.select(
        "doc_id",
        *[count("base", of_kind(k)).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(listed("base"), 256).alias("base_sha256"), listed("kept").alias("spans"),
        count("kept", lambda s: ~s["copied"]).alias("n_live"),
        count("kept", lambda s: s["copied"]).alias("n_copied"))
