"""The queries of the training-data operators and the SQL that they must equal, where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import extraction, fingerprints, language, language_model, media, near_dups, packing, quality, sentencepieces, urls
from .common import table

QUERIES = {}
ORACLE = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op3_url_filters(spark, sf_dir):
    return urls.judged(table(spark, sf_dir, "pages"), urls.rules_table(spark))


ORACLE["op3_url_filters"] = """
with parts as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages
), split as (
  select page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1), '') as path
  from parts
), rules(r_host, r_path, r_verdict) as (
  values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), matched as (
  select page_id, host, path, r_host || r_path as rule, r_verdict
  from split left join rules on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path)
)
select page_id, host, path, rule, coalesce(r_verdict, 'allow') as verdict from matched
qualify row_number() over (partition by page_id order by length(rule) desc nulls last) = 1
"""


@_query
def op9_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"))


@_query
def op10_media_columns(spark, sf_dir):
    return media.media_digests(table(spark, sf_dir, "documents"))


@_query
def op6_document_fingerprints(spark, sf_dir):
    return fingerprints.with_neighbours(fingerprints.fingerprints_with_edits(table(spark, sf_dir, "documents")))


@_query
def op1_language_id(spark, sf_dir):
    return language.languages(table(spark, sf_dir, "documents"))


@_query
def op5_quality_classifier(spark, sf_dir):
    return quality.qualities(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op2_near_duplicates(spark, sf_dir):
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


@_query
def op8_lm_scoring(spark, sf_dir):
    return language_model.scored(table(spark, sf_dir, "documents"))


@_query
def op4_html_extraction(spark, sf_dir):
    return extraction.extracted(table(spark, sf_dir, "pages"))


@_query
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@_query
def op7_sentencepiece(spark, sf_dir):
    return sentencepieces.piece_digests(table(spark, sf_dir, "documents"))


# Columns of the operators' results that SQL can say, as queries of their own.


@_query
def media_payloads(spark, sf_dir):
    return op10_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


ORACLE["media_payloads"] = r"""
with raw as (
  select doc_id, encode(coalesce(text, '')) as b from documents
), sized as (
  select doc_id, b, cast(octet_length(b) as bigint) as n, greatest(576, cast(ceil(octet_length(b) / 576.0) as bigint) * 576) as m from raw
)
select doc_id, n as n_bytes, m as payload_bytes, sha256(b || repeat('\xFF'::blob, m - n)) as payload_sha256 from sized
"""


@_query
def edited_texts(spark, sf_dir):
    return fingerprints.fingerprints_with_edits(table(spark, sf_dir, "documents")).select("doc_id", "n_chars", "edited_sha256")


ORACLE["edited_texts"] = """
with own as (
  select doc_id, coalesce(text, '') as t, lead(coalesce(text, '')) over (order by doc_id desc) as following, first_value(coalesce(text, '')) over (order by doc_id desc) as top from documents
), halves as (
  select doc_id, t, coalesce(following, top) as following, cast(length(t) as bigint) as n from own
)
select doc_id, n as n_chars, sha256(substring(t, 1, n - n // 2) || substring(following, 1, n // 2)) as edited_sha256 from halves
"""


@_query
def lm_base_scores(spark, sf_dir):
    rows = op8_lm_scoring(spark, sf_dir)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


ORACLE["lm_base_scores"] = r"""
with recursive bits(i, k, c) as (
  select i, 0, cast(i as bigint) from range(256) t(i) union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bits where k < 8
), bytes as (
  select i, c from bits where k = 8
), crc(doc_id, s, place, c) as (
  select distinct doc_id, cast(doc_id as varchar), cast(1 as bigint), cast(4294967295 as bigint) from documents
  union all
  select doc_id, s, place + 1, xor(crc.c >> 8, bytes.c) from crc join bytes on bytes.i = xor(crc.c & 255, ord(substring(s, place, 1))) & 255 where place <= length(s)
), folds as (
  select doc_id, xor(c, 4294967295) % 10 = 0 as held_out from crc where place = length(s) + 1
), words as (
  select doc_id, unnest(list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ')) as w from documents
), counts as (
  select w, count(*) as c from words join folds using (doc_id) where not held_out group by w
), totals as (
  select cast(sum(c) as bigint) as n, count(*) as v from counts
)
select doc_id, held_out, count(*) as n_tokens, count(c) as n_known, any_value(n) as train_tokens, round(sum(log10((coalesce(c, 0) + 0.1) / (n + 0.1 * (v + 1)))), 3) as base_score
from words join folds using (doc_id) left join counts using (w) cross join totals group by doc_id, held_out
"""


ORACLE["op2_near_duplicates"] = r"""
with recursive split as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
                      else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s
  from split
), sizes as (
  select doc_id, cast(len(s) as bigint) as n from sets
), shingles as (
  select doc_id, unnest(s) as x from sets
), common as (
  select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a join shingles b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2
), links as (
  select a, b from common c join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c.n >= 85 * (x.n + y.n - c.n)
), both_ways as (
  select a, b from links union all select b, a from links
), reach(doc_id, other) as (
  select doc_id, doc_id from sizes union select reach.doc_id, b from reach join both_ways on reach.other = a
)
select sizes.doc_id, n as n_shingles, min(other) as component_id, sizes.doc_id = min(other) as kept
from sizes join reach on sizes.doc_id = reach.doc_id group by sizes.doc_id, n
"""
