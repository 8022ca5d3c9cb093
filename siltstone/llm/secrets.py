"""Secret scans (2): base patterns plus multipart credential linking, in DataFrame functions only.

Every whole text is scanned for three base kinds, reported wherever they match:

* ``assign``: a credential word, ``:`` or ``=``, and a value of six characters or more;
* ``access``: an access-key identifier of twenty characters or more;
* ``hex``: a run of 24 or more lower-case hexadecimal digits.

Weak candidates mean little alone: ``id`` (a user or client name set to a value), ``key`` (a run of 32 or
more base64-like characters with upper case, lower case and a digit) and ``endpoint`` (a URL). They are
linked to complementary parts (identifier, secret, endpoint) by an interval join: parts of one text are
put into bins as wide as the scope, joined on (row, bin), and kept within ``scope`` code points of each
other. A weak candidate is reported only if such a partner exists: an identifier needs a secret, a
secret an identifier or an endpoint, an endpoint a secret. Weak candidates inside a base span are the
base span's. Pairs are made inside bins of ``scope`` characters only, so their number is linear in the text.

Defined results: null and empty texts give no spans; null ids and repeated rows are scanned like others,
row by row; columns other than the id and the text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import cut

KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
IDENT = r"""((?i)user_?name|user_?id|client_?id|access_?key_?id|account|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})"""
KEY = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}"
ENDPOINT = r"""[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x20\x09-\x0D"'<>]+"""
_BLOCK = 256


def _running(lengths: Column) -> Column:
    """Sums of the elements before each one; two levels keep the appends linear in the array."""

    def fold(array: Column, start: Column) -> Column:
        return F.aggregate(
            array,
            F.struct(start.cast("int").alias("s"), F.array().cast("array<int>").alias("out")),
            lambda a, x: F.struct((a["s"] + x).cast("int").alias("s"), F.concat(a["out"], F.array(a["s"])).alias("out")),
            lambda a: a["out"],
        )

    blocks = F.sequence(F.lit(0), ((F.size(lengths) - 1) / _BLOCK).cast("int"))
    part = lambda b: F.slice(lengths, b * _BLOCK + 1, _BLOCK)
    sums = F.transform(blocks, lambda b: F.aggregate(part(b), F.lit(0), lambda a, x: (a + x).cast("int")))
    return F.flatten(F.zip_with(blocks, fold(sums, F.lit(0)), lambda b, s: fold(part(b), s)))


def _spans(text: Column, pattern: str, kind: str, keep=lambda match, value: F.lit(True), group: int = 0) -> Column:
    """Spans (start, kind, end) of the leftmost non-overlapping matches, in code points.

    The pieces between the matches and the matches themselves alternate, so positions are running sums.
    """
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gap = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(match)), F.length)
    start = F.zip_with(_running(F.zip_with(gap, match, lambda g, m: g + F.length(m))), gap, lambda s, g: s + g)
    both = F.arrays_zip(start.alias("s"), match.alias("m"), value.alias("v"))
    order = F.lit(KINDS.index(kind))
    found = F.transform(
        F.filter(both, lambda x: keep(x["m"], x["v"])),
        lambda x: F.struct(x["s"].alias("start"), order.alias("kind"), (x["s"] + F.length(x["m"])).alias("end")),
    )
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _label(span: Column) -> Column:
    name = F.element_at(F.array(*map(F.lit, KINDS)), span["kind"] + 1)
    return F.concat_ws(":", name, span["start"].cast("string"), span["end"].cast("string"))


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = 256) -> DataFrame:
    """One row per row of ``docs``: the id, ``base`` and ``linked``, arrays of (start, kind, end), sorted."""
    t = F.col("_t")
    strong = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumn(
        "base",
        F.concat(
            _spans(t, ASSIGN, "assign", lambda m, v: F.length(v) >= 6, 2),
            _spans(t, ACCESS, "access"),
            _spans(t, HEX, "hex"),
        ),
    )
    mixed = lambda m, _: m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]")
    outer = strong.withColumn("weak", F.concat(_spans(t, IDENT, "id"), F.when(t.contains("://"), _spans(t, ENDPOINT, "endpoint")).otherwise(F.array().cast(_SPAN))))
    scanned = cut(
        outer.select(
            F.monotonically_increasing_id().alias("_row"),
            "doc_id",
            F.array_sort("base").alias("base"),
            F.concat("weak", F.when(F.size("base") + F.size("weak") > 0, _spans(t, KEY, "key", mixed)).otherwise(F.array().cast(_SPAN))).alias("weak"),
        )
    )
    parts = (
        scanned.where(F.size("weak") > 0)
        .select("_row", F.explode(F.concat("base", "weak")).alias("p"))
        .select("_row", "p.*", F.expr("CASE WHEN kind IN (1, 3) THEN 'i' WHEN kind = 5 THEN 'e' ELSE 's' END").alias("role"))
    )
    bins = lambda low, high: F.explode(F.sequence(F.floor(low / scope), F.floor(high / scope))).alias("_bin")
    weak = parts.where("kind > 2").select("_row", "start", "end", "kind", "role", bins(F.greatest(F.lit(0), F.col("start") - scope), F.col("end") + scope))
    other = parts.select("_row", F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("kind").alias("k2"), F.col("role").alias("r2"), bins(F.col("start"), F.col("end")))
    pairs = weak.join(other, ["_row", "_bin"]).where("s2 <= end + %d AND e2 >= start - %d" % (scope, scope))
    inside = F.max((F.col("k2") < 3) & (F.col("s2") <= F.col("start")) & (F.col("e2") >= F.col("end")))
    partner = F.expr("role = 'i' AND r2 = 's' OR role = 's' AND r2 IN ('i', 'e') OR role = 'e' AND r2 = 's'")
    apart = (F.col("s2") >= F.col("end")) | (F.col("e2") <= F.col("start"))
    linked = (
        pairs.groupBy("_row", "start", "end", "kind")
        .agg(inside.alias("inside"), F.max(partner & apart).alias("linked"))
        .where("linked AND NOT inside")
        .groupBy("_row")
        .agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("linked"))
    )
    return scanned.join(linked, "_row", "left").select("doc_id", "base", F.coalesce("linked", F.array().cast(_SPAN)).alias("linked"))


def secret_digest(found: DataFrame) -> DataFrame:
    """The columns of query op2 from ``find_secrets``."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, _label), ",")
    return found.select(
        "doc_id",
        *map(count, KINDS[:3]),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "linked"))).alias("spans"),
        F.size("linked").cast("long").alias("n_linked"),
    )
