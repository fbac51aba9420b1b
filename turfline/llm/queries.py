"""The registered queries of this subpackage and their SQL for DuckDB."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, exact_dedup, license_scan, media_sniff, quality_knn, secret_scan, simhash_bk, source_mix, token_counts, toxicity_ftrl

MULTI_RANKS = "byte_bpe_multi_50k.tiktoken"
GPT_LIKE = "byte_bpe_50k.json"


def _read(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.decisions(_read(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op2_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.classify(_read(spark, sf_dir), _read(spark, sf_dir, "labels"))


def op3_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_ftrl.classify(_read(spark, sf_dir), _read(spark, sf_dir, "labels"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media_sniff.store_and_inspect(_read(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "corrected")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe_codec.round_trip(_read(spark, sf_dir), public_tokenizers.path(MULTI_RANKS), public_tokenizers.PATTERN)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir), public_tokenizers.path(GPT_LIKE))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf_dir))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_read(spark, sf_dir)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(_read(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_bk.groups(_read(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_quality_neighbours,
        op3_toxicity_ftrl,
        op4_media_columns,
        op5_byte_bpe,
        op6_token_counts,
        op7_license_scan,
        op8_secret_scan,
        op9_source_mix,
        op10_simhash_groups,
    )
}

OP1_SQL = """
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256
from (
  select doc_id, sha256(coalesce(text, '')) as text_sha256,
         max(doc_id) over (partition by coalesce(text, '')) as keep_id,
         count(*) over (partition by coalesce(text, '')) as group_size
  from documents
)
"""


def _op7_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ",\n".join(f"({quoted(i)}, {quoted(body)})" for i, body in license_scan.KNOWN)
    return f"""
with known as (
  select sha256({license_scan.canonical_sql("body")}) as digest, min(license_id) as license_id
  from (values {known}) as t(license_id, body) group by 1
),
docs as (select doc_id, coalesce(text, '') as text from documents),
wholes as (select doc_id, sha256({license_scan.canonical_sql("text")}) as canonical_sha256 from docs),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line from docs),
hits as (
  select doc_id, string_agg(distinct license_id, ',' order by license_id) as line_licenses, count(*) as n_license_lines
  from lines join known on sha256({license_scan.canonical_sql("line")}) = digest group by doc_id
)
select doc_id, canonical_sha256, license_id, coalesce(line_licenses, '') as line_licenses, coalesce(n_license_lines, 0) as n_license_lines
from wholes left join known on canonical_sha256 = digest left join hits using (doc_id)
"""


def _op8_sql() -> str:
    scan = secret_scan
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    # a bare key is a run of the wider class that is forty characters of the narrower one
    kinds = ((scan.ASSIGN, 2), (scan.ACCESS, 0), (scan.HEX, 0), ("[A-Za-z0-9+/=_.-]+", 0), (scan.ENDPOINT, 0))
    raw = " union all ".join(
        f"select doc_id, {kind} as kind, unnest(range(0, len(ms))) as i, unnest(ms) as m, unnest(ks) as k, unnest(list_slice(gs, 1, len(ms))) as g from ("
        f"select doc_id, regexp_extract_all(text, {quoted(p)}) as ms, regexp_extract_all(text, {quoted(p)}, {group}) as ks, string_split_regex(text, {quoted(p)}) as gs from docs) x{kind}"
        for kind, (p, group) in enumerate(kinds)
    )
    roles = " ".join(f"when {k} then '{scan.PART[name]}'" for k, name in enumerate(scan.KINDS))
    names = " ".join(f"when {k} then '{name}'" for k, name in enumerate(scan.KINDS))
    return f"""
with docs as (select doc_id, coalesce(text, '') as text from documents),
raw as ({raw}),
placed as (select doc_id, kind, k, m, cast(sum(length(g) + length(m)) over (partition by doc_id, kind order by i) as bigint) as e from raw),
parts as (
  select doc_id, kind, e - length(m) as s, e, case kind when 0 then length(k) < {scan.LEAST_ASSIGN} when 1 then length(k) < {scan.LEAST_ACCESS} when 2 then false else true end as weak,
    case kind {roles} end as role
  from placed
  where case kind when 0 then length(k) >= {scan.LEAST_WEAK_ASSIGN} when 1 then length(k) >= {scan.LEAST_WEAK_ACCESS} when 3 then regexp_full_match(m, '[A-Za-z0-9+/]{{40}}') else true end
),
linked as (
  select distinct w.doc_id, w.kind, w.s, w.e from parts w join parts o on w.doc_id = o.doc_id and w.role <> o.role and o.s < w.e + {scan.SCOPE} and o.e > w.s - {scan.SCOPE} where w.weak
),
base as (select doc_id, kind, s, e from parts where not weak),
listed as (
  select doc_id, string_agg(concat(case kind {names} end, ':', s, ':', e), ',' order by s, kind, e) as spans from (select * from base union all select * from linked) u group by doc_id
),
based as (
  select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
    string_agg(concat(case kind {names} end, ':', s, ':', e), ',' order by s, kind, e) as line
  from base group by doc_id
)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(line, '')) as base_sha256, coalesce(spans, '') as spans
from docs d left join based b on d.doc_id = b.doc_id left join listed l on d.doc_id = l.doc_id
"""


OP9_SQL = f"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents
),
by0 as (select source, sum(size)::bigint as source_size from sized group by source),
by1 as (
  select *, case (row_number() over (order by encode(source) nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight,
         (source_size * {source_mix.MAX_EPOCHS})::double as cap
  from by0
),
by2 as (
  select *, (sum(source_size) over () * {source_mix.TOTAL_SHARE}::double
             - coalesce(sum(cap) over (order by cap / weight, encode(source) nulls last rows between unbounded preceding and 1 preceding), 0.0))
            / sum(weight) over (order by cap / weight, encode(source) nulls last rows between current row and unbounded following) as level
  from by1
),
by3 as (select *, (select arg_min(level, cap / weight) from by2 where cap > weight * level) as shared from by2),
plan as (
  select source, source_size, case when shared is null or cap <= weight * shared then cap else weight * shared end as target from by3
),
plan2 as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as certain from plan
),
plan3 as (
  select *, greatest(0.0::double, target - certain * source_size) as rest from plan2
),
per as (select source, size, count(*) as n from sized where size > 0 group by source, size),
sums as (
  select source, size, sum(size * size * n) over (partition by source order by size rows between unbounded preceding and current row)::bigint as squares,
         coalesce(sum(size * n) over (partition by source order by size rows between 1 following and unbounded following), 0)::bigint as above
  from per
),
fits as (
  select s.source, arg_max((p.rest - s.above) / s.squares::double, s.size) as factor
  from sums s join plan3 p on s.source is not distinct from p.source
  where p.rest > 0 and s.squares::double / s.size + s.above >= p.rest group by s.source
),
ranked0 as (
  select s.*, p.source_size, p.target, p.certain, p.rest, least(1.0::double, coalesce(f.factor, 0.0::double) * s.size) as p,
         (('0x' || substr(sha256('{source_mix.SEED}:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint::double + 0.5) / {float(1 << 52)!r}::double as u
  from sized s join plan3 p on s.source is not distinct from p.source left join fits f on s.source is not distinct from f.source
),
ranked1 as (select *, case when p > 0 and p < 1 then (u / (1 - u)) / (p / (1 - p)) end as odds from ranked0),
ranked as (select *, case when p >= 1 then 0.0::double when p > 0 then odds / (1 + odds) end as q from ranked1),
running as (
  select source, q, doc_id, size, rest, own, sum(own) over (partition by source order by q, doc_id, size) as total
  from (select source, q, doc_id, size, rest, size * count(*) as own from ranked where q is not null group by source, q, doc_id, size, rest)
),
chosen as (select source, q, doc_id, size from running where 2 * total - own < 2 * rest)
select r.doc_id, r.size, r.source_size, r.target,
       (case when r.size > 0 then (r.certain + case when c.q is not null then 1 else 0 end) * r.size else 0 end)::bigint as taken
from ranked r left join chosen c on r.source is not distinct from c.source and r.q = c.q and r.doc_id is not distinct from c.doc_id and r.size = c.size
"""

ORACLES = {"op1_exact_dedup": OP1_SQL, "op7_license_scan": _op7_sql(), "op8_secret_scan": _op8_sql(), "op9_source_mix": OP9_SQL}
