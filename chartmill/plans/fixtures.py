"""Derived relations that stand for the library's inputs, as SQL that two engines read alike.

`{name}` is a table. The texts take whole tables; moduli only vary what a row holds.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

NOTES = "select cast(doc_id as varchar(20)) as id, text as progress_note, lang, source from {documents}"
LINES = "select l_orderkey as doc_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as ord, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_returnflag, l_shipdate from {lineitem}"
ITEMS = (
    "select doc_id, ord, 'Timestamp' as key, substr(cast(l_shipdate as varchar(30)), 1, 10) as atom, 'gold' as side from li "
    "union all select doc_id, ord, 'TumorSize', cast(cast(l_quantity as bigint) as varchar(10)), 'gold' from li "
    "union all select doc_id, ord, 'Recurrence', case l_returnflag when 'R' then 'あり' else 'なし' end, 'gold' from li "
    "union all select doc_id, ord, 'Timestamp', substr(cast(l_shipdate as varchar(30)), 1, 10), 'pred' from li where l_discount > 0.01 "
    "union all select doc_id, ord, 'TumorSize', cast(cast(l_quantity as bigint) + case when l_suppkey % 5 = 0 then 1 else 0 end as varchar(10)), 'pred' from li where l_discount > 0.01 "
    "union all select doc_id, ord, 'Recurrence', case when l_linenumber % 3 = 0 then 'なし' else case l_returnflag when 'R' then 'あり' else 'なし' end end, 'pred' from li where l_discount > 0.01"
)
#: The same relation for Spark, from one pass over the lines.
EXPLODED_ITEMS = (
    "select doc_id, ord, x.key, x.atom, x.side from (select doc_id, ord, l_discount, explode(array("
    "named_struct('key', 'Timestamp', 'atom', substr(cast(l_shipdate as varchar(30)), 1, 10), 'side', 'gold'), "
    "named_struct('key', 'TumorSize', 'atom', cast(cast(l_quantity as bigint) as string), 'side', 'gold'), "
    "named_struct('key', 'Recurrence', 'atom', case l_returnflag when 'R' then 'あり' else 'なし' end, 'side', 'gold'), "
    "named_struct('key', 'Timestamp', 'atom', substr(cast(l_shipdate as varchar(30)), 1, 10), 'side', 'pred'), "
    "named_struct('key', 'TumorSize', 'atom', cast(cast(l_quantity as bigint) + case when l_suppkey % 5 = 0 then 1 else 0 end as string), 'side', 'pred'), "
    "named_struct('key', 'Recurrence', 'atom', case when l_linenumber % 3 = 0 then 'なし' else case l_returnflag when 'R' then 'あり' else 'なし' end end, 'side', 'pred'))) as x from li) where x.side = 'gold' or l_discount > 0.01"
)
COUNTED = f"with li as ({LINES}), it as ({ITEMS}) select doc_id, ord, key, atom, count_if(side = 'gold') as gold_n, count_if(side = 'pred') as pred_n from it group by doc_id, ord, key, atom"
EVENT_TEXTS = (
    f"with li as ({LINES}) select doc_id, ord, concat('{{{{\"Timestamp\": \"', substr(cast(l_shipdate as varchar(30)), 1, 10), '\", \"TumorSize\": ', cast(cast(l_quantity as bigint) as varchar(10)), "
    "', \"Recurrence\": \"', case l_returnflag when 'R' then 'あり' else 'なし' end, '\", \"Treatment\": \"', case l_linenumber % 3 when 0 then '手術, 化学療法' when 1 then '手術、放射線療法' else '未知療法' end, "
    "'\"', case when l_suppkey % 4 = 0 then ', \"UnknownKey\": \"x\"' else '' end, '}}') as ev from li"
)
ANNOTATIONS = {
    "spark": f"select doc_id, concat('[', listagg(ev, ', ') within group (order by ord), ']') as annotation from ({EVENT_TEXTS}) group by doc_id",
    "duckdb": f"select doc_id, concat('[', string_agg(ev, ', ' order by ord), ']') as annotation from ({EVENT_TEXTS}) group by doc_id",
}
DAMAGE = (
    "select doc_id, case doc_id % 8 when 0 then annotation when 1 then concat('```json', chr(10), annotation, chr(10), '```') when 2 then substr(annotation, 1, length(annotation) - 1) "
    "when 3 then replace(annotation, '}}', ',}}') when 4 then replace(annotation, '\"TumorSize\": ', '\"TumorSize\": 約') when 5 then concat('[補完情報] ', annotation) "
    "when 6 then concat('[', substr(annotation, 2, length(annotation) - 2), ', ', substr(annotation, 2, length(annotation) - 2), ']') else concat('note: ', substr(annotation, 2, length(annotation) - 2)) end as raw from "
)
DOC_KEYS = (
    "select case l_returnflag when 'A' then 'zero_shot' when 'N' then 'ft_mock' else 'ft_all' end as condition, cast(42 + l_linenumber % 5 as varchar(4)) as seed, cast((l_orderkey % 96) % 5 as varchar(4)) as fold, "
    "cast(l_orderkey % 96 as varchar(4)) as doc_id, concat('K', lpad(cast(l_partkey % 37 as varchar(4)), 2, '0')) as key, cast(sum(case when l_quantity <= 25 then 1 else 0 end) as bigint) as tp, "
    "cast(sum(case when l_quantity > 25 and l_quantity <= 38 then 1 else 0 end) as bigint) as fp, cast(sum(case when l_quantity > 38 then 1 else 0 end) as bigint) as fn from {lineitem} group by 1, 2, 3, 4, 5"
)
RUN_LOG = (
    "select concat(cast(conv_id as varchar(20)), '-', cast(turn as varchar(20))) as id, role, length(text) as n_gen_tokens, cast((length(text) * 7) % 1000 as double) / 100 as gen_seconds, turn % 3 <> 0 as final_channel_found, "
    "length(text) > 500 as hit_max_new_tokens, case when role = 'system' then '[]' else '[{{\"Stage\": \"StageⅠ\"}}]' end as pred_annotation from {conversations}"
)
TRAIN_LOG = "select event_id as ord, (event_id % 200) * 10 as step, case when event_type = 'view' then value end as train_loss, case when event_type = 'purchase' then value end as val_loss from {events}"
CHANNELS = (
    "select concat(cast(conv_id as varchar(20)), '-', cast(turn as varchar(20))) as id, text, role, concat('<|start|>assistant<|channel|>analysis<|message|><think>', text, '</think><|end|>', "
    "case when role = 'assistant' then concat('<|channel|>final<|message|>', text, '<|return|>') else '' end) as raw_pred_annotation from {conversations}"
)
DATES = (
    "select o_orderkey as id, concat(case when (o_orderkey / 8) % 2 >= 1 then ' 　' else '' end, case o_orderkey % 8 "
    "when 0 then concat(cast(year(o_orderdate) as varchar(4)), '-', lpad(cast(month(o_orderdate) as varchar(2)), 2, '0'), '-', lpad(cast(day(o_orderdate) as varchar(2)), 2, '0')) "
    "when 1 then concat(cast(year(o_orderdate) as varchar(4)), '/', cast(month(o_orderdate) as varchar(2)), '/', cast(day(o_orderdate) as varchar(2))) "
    "when 2 then concat(cast(year(o_orderdate) as varchar(4)), '.', cast(month(o_orderdate) as varchar(2)), '.', cast(day(o_orderdate) as varchar(2))) "
    "when 3 then concat(cast(year(o_orderdate) as varchar(4)), '年', cast(month(o_orderdate) as varchar(2)), '月', cast(day(o_orderdate) as varchar(2)), '日') "
    "when 4 then concat(cast(year(o_orderdate) as varchar(4)), '-', cast(month(o_orderdate) as varchar(2))) "
    "when 5 then concat(cast(year(o_orderdate) as varchar(4)), '年', cast(month(o_orderdate) as varchar(2)), '月') "
    "when 6 then cast(year(o_orderdate) as varchar(4)) else concat('不明', cast(year(o_orderdate) as varchar(4))) end) as raw_date, o_orderdate from {orders}"
)
LISTS = (
    "select p_partkey as id, concat(p_type, case p_partkey % 5 when 0 then '、' when 1 then '，' when 2 then '＋' when 3 then '､' else ' , ' end, p_brand, "
    "case when p_partkey % 3 = 0 then '++' else '' end, ' ', p_type) as raw_list from {part}"
)


def spark_sql(spark: SparkSession, sf_dir: str, sql: str, deal: str | None = None) -> DataFrame:
    """Run fixture SQL over the Parquet tables of a folder; the views are temporary to the text.

    deal names a column by which the rows are dealt over all tasks before anything else; windows, groups and
    joins by it then move nothing more.
    """
    used = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in TABLES if f"{{{name}}}" in sql}
    if deal is not None:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        used = {name: df.repartition(parts, deal) for name, df in used.items()}
    return spark.sql(sql, **used)


def duckdb_sql(sql: str) -> str:
    """The same text for an engine where the tables are views."""
    return re.sub(r"\{(\w+)\}", r"\1", sql).replace("{{", "{").replace("}}", "}")
