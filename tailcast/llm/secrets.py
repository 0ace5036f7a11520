"""Secret scan with multipart credential linking, in DataFrame functions only."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, text_of

SCOPE = 200                    # code points between the starts of parts that belong together

# Kinds in the order in which they are listed, each with its pattern, the group that is
# measured, the least length of that group, and a cheaper pattern without which no match exists.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = {
    "assign": (ASSIGN, 2, 6, r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"),
    "access": (r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    "hex": (r"[0-9a-f]{24,}", 0, 24, r"[0-9a-f]{24}"),
}
WEAK = {
    "ident": (r"""(?i)(user|username|login|client_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]+)""", 2, 4,
              r"(?i)(user|username|login|client_?id|key_?id)[\"']?\x20*[:=]"),
    "opaque": (r"[A-Za-z0-9+/_-]{32,}", 0, 32, r"[A-Za-z0-9+/_-]{32}"),
    "endpoint": (r"(?i)[a-z][a-z0-9+.-]*://[a-z0-9][a-z0-9.:/_-]*|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+(:[0-9]+)?", 0, 8,
                 r"://|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]"),
}
KINDS = (*BASE, *WEAK)
IDENTIFIERS, SECRETS = ("access", "ident"), ("assign", "hex", "opaque")


def _pieces(text: Column, pattern: str, group: int, least: int, needed: str, hint: Column) -> Column:
    """Lengths around each match: text before it, the match, and whether it holds.  Splitting by
    the pattern gives the text between matches, so places follow from lengths alone."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)) if group else found
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("before"), whole.alias("whole"), found.alias("value"))
    mixed = (lambda z: z["value"].rlike("[0-9]") & z["value"].rlike("[A-Za-z]")) if pattern == WEAK["opaque"][0] else (lambda z: F.lit(True))
    lengths = F.transform(F.filter(zipped, lambda z: z["whole"].isNotNull()), lambda z: F.struct(
        F.length(z["before"]).alias("gap"), F.length(z["whole"]).alias("size"), ((F.length(z["value"]) >= least) & mixed(z)).alias("holds")))
    return F.when(hint & text.rlike(needed), lengths)


def _spans(rows: DataFrame, kinds) -> DataFrame:
    """(row, kind, start, stop) of every match that holds, by running sums over a text's matches."""
    each = reduce(DataFrame.unionByName, [rows.where(F.size(k) > 0).select("row", F.lit(KINDS.index(k)).alias("kind"), F.posexplode(k).alias("at", "m"))
                                          .select("row", "kind", "at", "m.*") for k in kinds])
    upto = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.col("size")).over(upto)
    return each.withColumn("stop", stop).where("holds").select("row", "kind", (F.col("stop") - F.col("size")).alias("start"), "stop")


def _near(weak: DataFrame, anchors: DataFrame, name: str, scope: int) -> DataFrame:
    """Interval join: does an anchor start within ``scope`` of the candidate?  Anchors are reduced to one
    row per bin of that width; in the candidate's own bin any anchor is near enough, in the neighbours
    only the last or the first can decide, so no pairs are made."""
    b = (F.col("start") / scope).cast("long")
    cells = anchors.groupBy("row", b.alias("cell")).agg(F.min("start").alias("first"), F.max("start").alias("last"))
    seen = (cells.select("row", F.explode(F.array(*[F.struct((F.col("cell") + d).alias("cell"), F.when(F.lit(d == 0), True).alias("own"),
                                                             (F.col("last") if d == 1 else F.lit(None).cast("long")).alias("left"),
                                                             (F.col("first") if d == -1 else F.lit(None).cast("long")).alias("right")) for d in (-1, 0, 1)])).alias("s"))
            .select("row", "s.*").groupBy("row", "cell").agg(F.max("own").alias("own"), F.max("left").alias("left"), F.min("right").alias("right")))
    hit = (F.coalesce(F.col("own"), F.lit(False)) | F.coalesce(F.col("start") - F.col("left") <= scope, F.lit(False))
           | F.coalesce(F.col("right") - F.col("start") <= scope, F.lit(False)))
    return weak.withColumn("cell", b).join(seen, ["row", "cell"], "left").withColumn(name, hit).drop("cell", "own", "left", "right")


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per document: key, ``found`` (all spans, sorted by start and kind, as structs of kind,
    start and stop in code points, stop exclusive) and ``base`` (the spans of the strong kinds).

    Assignments, access identifiers and long hexadecimal runs stand on their own.  The weak kinds are
    reported only in company: an opaque run near an identifier, an identifier assignment near a
    secret, an endpoint near both; parts are near if they start within ``scope`` code points.  An
    opaque run that overlaps a strong span is that span.

    A null text counts as empty and gives a row without spans; a null or repeated key is kept, row by
    row.  Texts are scanned whole and once; only spans are shuffled.  Other columns are not read."""
    t = text_of(text)
    strong = {k: _pieces(t, *v, F.lit(True)) for k, v in BASE.items()}
    some = t.rlike("|".join(f"(?:{v[3]})" for v in (*BASE.values(), WEAK["opaque"])))
    weak = {k: _pieces(t, *v, some) for k, v in WEAK.items()}
    rows = stage(docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("k"), *[c.alias(k) for k, c in (strong | weak).items()]), "secret-rows")
    spans = stage(_spans(rows, KINDS), "secret-spans")
    base = spans.where(F.col("kind") < len(BASE))
    order = Window.partitionBy("row").orderBy("start", "kind")
    strong_stop, strong_start = F.when(F.col("kind") < len(BASE), F.col("stop")), F.when(F.col("kind") < len(BASE), F.col("start"))
    clear = (spans.withColumn("reach", F.max(strong_stop).over(order.rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("next", F.min(strong_start).over(order.rowsBetween(0, Window.unboundedFollowing)))
             .where((F.col("kind") >= len(BASE)) & ((F.col("kind") != KINDS.index("opaque"))
                    | ((F.coalesce(F.col("reach"), F.lit(0)) <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("stop"))))))
             .drop("reach", "next"))
    clear = stage(clear, "secret-weak")
    parts = base.unionByName(clear)
    number = lambda names: [KINDS.index(n) for n in names]
    linked = _near(clear, parts.where(F.col("kind").isin(number(IDENTIFIERS))), "by_identifier", scope)
    linked = _near(linked, parts.where(F.col("kind").isin(number(SECRETS))), "by_secret", scope)
    kept = linked.where(F.when(F.col("kind") == KINDS.index("opaque"), F.col("by_identifier")).when(F.col("kind") == KINDS.index("ident"), F.col("by_secret"))
                        .otherwise(F.col("by_identifier") & F.col("by_secret")))
    every = base.unionByName(kept.select(base.columns)).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "stop"))).alias("s"))
    name = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(i), F.lit(k))])
    spelt = lambda a: F.transform(a, lambda s: F.struct(name[s["kind"]].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    none = F.expr("cast(array() as array<struct<start:bigint,kind:int,stop:bigint>>)")
    joined = rows.select("row", "k").join(every, "row", "left").withColumn("s", F.coalesce("s", none))
    return joined.select(F.col("k").alias(key), spelt("s").alias("found"), spelt(F.filter("s", lambda s: s["kind"] < len(BASE))).alias("base"))


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the strong kinds, the hash of their places, and all spans as text."""
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return scanned.select(key, *[count(k) for k in BASE], F.sha2(joined("base"), 256).alias("base_sha256"), joined("found").alias("spans"))
