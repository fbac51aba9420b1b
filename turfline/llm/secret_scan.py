"""Secret scan with multipart credential linking: DataFrame functions only.

Base spans are the matches of the patterns of each kind. Positions are code points, end exclusive; they come
from the lengths of the pieces between the matches. Weaker candidates (bare forty-character keys, short
assignments, short access identifiers, endpoints) count only when a part of another role, weak or not, lies within
SCOPE characters: candidates and parts are interval-joined on the cells of a grid of that width, each cell's parts
being folded to one row of presence and extent first, so that no pairs are formed.

Null texts count as empty and have no spans. Repeated rows give repeated results. An empty table gives an empty
result. Extra columns are ignored. Very long texts are scanned whole; of overlapping kinds all spans are listed, by start, kind and end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, whole_text

# The patterns of the kinds, in their listed order, and the least length of what they keep.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

# Weaker candidates of the linking: key bodies, endpoints. Short assignments and accesses are the dropped base matches.
BARE_KEY = r"(?<![A-Za-z0-9+/=_.-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_.-])"
ENDPOINT = r"[a-z][a-z0-9+.-]*://[A-Za-z0-9.-]+(?::[0-9]+)?"
LEAST_WEAK_ASSIGN, LEAST_WEAK_ACCESS = 6, 12

SCOPE = 400

KINDS = ("assign", "access", "hex", "key", "endpoint")
#: What each kind is a part of: an identifier, a secret or an endpoint.
PART = {"assign": "secret", "access": "identifier", "hex": "secret", "key": "secret", "endpoint": "endpoint"}

LINKABLE = "size(parts) > 1 and exists(parts, s -> s.weak)"
SPAN = "struct<start:int,end:int,kind:int,weak:boolean>"


def _positions(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0, weak_least: int | None = None, weak: bool = False) -> Column:
    """Spans of all matches in order; those whose group is shorter than `least` are weak or go."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    zipped = F.zip_with(F.arrays_zip(gaps.alias("g"), whole.alias("m")), kept, lambda a, k: F.struct(F.length(a["g"]).alias("g"), F.length(a["m"]).alias("m"), F.length(k).alias("k")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["g"]
        floor = least if weak_least is None else weak_least
        span = F.struct(begin.alias("start"), (begin + x["m"]).alias("end"), F.lit(kind).alias("kind"), (F.lit(weak) | (x["k"] < least)).alias("weak"))
        return F.struct((begin + x["m"]).alias("at"), F.when(x["k"] >= floor, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate(zipped, start, step, lambda acc: acc["spans"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def find_parts(docs: DataFrame) -> DataFrame:
    """doc_id, base and weak: spans of every document."""
    text = whole_text()
    rows = docs.select("doc_id", text.alias("text"))
    t = F.col("text")
    rows = rows.select(
        "doc_id",
        _positions(t, ASSIGN, 0, 2, LEAST_ASSIGN, LEAST_WEAK_ASSIGN).alias("assign"),
        _positions(t, ACCESS, 1, 0, LEAST_ACCESS, LEAST_WEAK_ACCESS).alias("access"),
        _positions(t, HEX, 2).alias("hex"),
        _positions(t, BARE_KEY, 3, weak=True).alias("key"),
        _positions(t, ENDPOINT, 4, weak=True).alias("endpoint"),
    )
    return rows.select("doc_id", F.sort_array(F.concat("assign", "access", "hex", "key", "endpoint")).alias("parts"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def linked_candidates(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """parts, linked: of each distinct list of spans, the weak ones that have a complementary part within the scope.

    `parts` has a column parts. A candidate spans the cells from start - scope to end + scope; a part lies in the
    cells it covers. The join is on list and cell; distances are then compared with the nearest part of the cell.
    """
    lists = parts.filter(LINKABLE).select("parts").distinct()
    lists = lists.withColumn("list", F.sha2(F.to_json("parts").cast("binary"), 256))
    one = lists.select("list", F.explode("parts").alias("s")).select("list", "s.*")
    roles = F.array(*[F.lit(PART[k]) for k in KINDS])
    one = one.withColumn("role", F.element_at(roles, F.col("kind") + 1))
    cells = one.withColumn("cell", F.explode(F.sequence((F.col("start") / scope).cast("int"), ((F.col("end") - 1) / scope).cast("int"))))
    # parts that are weak themselves complement each other too
    extent = cells.groupBy("list", "cell", "role").agg(F.min("start").alias("first"), F.max("end").alias("last"))
    wanted = one.filter("weak").withColumn("cell", F.explode(F.sequence(((F.col("start") - scope) / scope).cast("int") - 1, ((F.col("end") + scope) / scope).cast("int"))))
    wanted = wanted.select("list", "cell", "start", "end", "kind", F.col("role").alias("own"))
    near = (F.col("first") < F.col("end") + scope) & (F.col("last") > F.col("start") - scope)
    links = wanted.join(extent, ["list", "cell"]).filter((F.col("own") != F.col("role")) & near)
    links = links.groupBy("list").agg(F.collect_set(F.struct("start", "end", "kind", F.lit(True).alias("weak"))).alias("linked"))
    return links.join(lists, "list").select(F.col("parts").alias("linked_parts"), "linked")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked."""
    found = staged(find_parts(docs), "secret-parts")
    links = linked_candidates(found, scope)
    # documents without linkable parts share few lists, the empty one above all: they stay out of the join
    rows = found.filter(LINKABLE).join(links, F.col("parts") == F.col("linked_parts"), "left").select("doc_id", "parts", "linked")
    rows = rows.unionByName(found.filter(f"not ({LINKABLE})").withColumn("linked", F.lit(None).cast(f"array<{SPAN}>")))
    base = F.filter("parts", lambda s: ~s["weak"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    linked = F.coalesce("linked", F.array().cast(f"array<{SPAN}>"))
    return rows.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat(base, linked)).alias("spans"),
        F.size(linked).cast("long").alias("n_linked"),
    )
