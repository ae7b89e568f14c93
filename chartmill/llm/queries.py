"""The queries opN_ over the whole tables, and the SQL that states their results where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, gif, htmltext, kneser, langid, licenses, minhash, packing, spotsigs, warc
from .common import prepare, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


#: The definition itself: all pairs that share a shingle, then everything reachable.
ORACLE_SQL["op4_minhash_forest"] = r"""
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) end) as s from d),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as u, b.doc_id as v, count(*) as k from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
e as (select u, v from p join n x on x.doc_id = u join n y on y.doc_id = v where 100 * k >= 75 * (x.n + y.n - k)),
b as (select u, v from e union all select v, u from e),
r as (select doc_id as node, doc_id as other from d union select r.node, b.v from r join b on r.other = b.u)
select d.doc_id, coalesce(any_value(n), 0) as n_shingles, min(other) as component_id, d.doc_id = min(other) as kept
from d join r on d.doc_id = r.node left join n on n.doc_id = d.doc_id group by d.doc_id
"""
ORACLE_SQL["op8_warc_bundles"] = """
with p as (select page_id, url, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as h from pages),
m as (select h, max(page_id) as top from p where n >= 1000 group by h)
select page_id, n as payload_bytes, p.h as payload_digest, case when top > page_id then 'revisit' else 'response' end as record_type, case when top > page_id then top end as refers_to, url
from p left join m on p.h = m.h
"""


@query
def op1_gif_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.digests(gif.store(table(spark, sf_dir, "documents")))


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.decode_documents(bpe.encode_documents(table(spark, sf_dir, "documents"), path), path, digest=True)


@query
def op3_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    model = langid.train(docs.filter(~langid.held_out()))
    return langid.identify(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "bits_per_symbol")


@query
def op4_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(prepare(spark), sf_dir, "documents"))


@query
def op5_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op7_host_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(table(spark, sf_dir, "pages"))


@query
def op8_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


@query
def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser.classify(table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edit_likeness(table(prepare(spark), sf_dir, "documents"))
