"""One named query per operator over the whole tables, with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hierarchy, schema
from ..functions import lenient_json as lj
from ..functions import text as tx
from ..operators import align, analytics, cleaning, generation, resampling, scoring, splits
from ..sources import files
from . import fixtures as fx
from .registry import ORACLE_SQL, QUERIES

Query = Callable[[SparkSession, str], DataFrame]
# Candidate lists of the keys that the fixtures hold.
CANDIDATES = {"Recurrence": ["あり", "なし"], "Treatment": ["手術", "化学療法", "放射線療法", "分子標的療法", "免疫療法"]}
SYSTEM, TEMPLATE = "Extract events.", "### Note:\n{{INPUT}}\n### Events:"
GUIDELINE = "List every event as JSON."


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = fx.duckdb_sql(sql)
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _prf(tp: str = "tp", fp: str = "fp", fn: str = "fn", prefix: str = "") -> str:
    """precision, recall and f1 of counted columns, rounded, as SQL."""
    p = f"(case when {tp} + {fp} > 0 then cast({tp} as double) / ({tp} + {fp}) else 0.0 end)"
    r = f"(case when {tp} + {fn} > 0 then cast({tp} as double) / ({tp} + {fn}) else 0.0 end)"
    f = f"(case when {p} + {r} > 0 then 2 * {p} * {r} / ({p} + {r}) else 0.0 end)"
    return f"round({p}, 9) as {prefix}precision, round({r}, 9) as {prefix}recall, round({f}, 9) as {prefix}f1"


def _f1(tp: str, fp: str, fn: str) -> str:
    p = f"(case when {tp} + {fp} > 0 then cast({tp} as double) / ({tp} + {fp}) else 0.0 end)"
    r = f"(case when {tp} + {fn} > 0 then cast({tp} as double) / ({tp} + {fn}) else 0.0 end)"
    return f"(case when {p} + {r} > 0 then 2 * {p} * {r} / ({p} + {r}) else 0.0 end)"


_JOINT = f"select doc_id, ord, key, least(gold_n, pred_n) as tp, gold_n, pred_n from ({fx.COUNTED})"
_TOTALS = "cast(sum(tp) as bigint) as tp, cast(sum(pred_n) - sum(tp) as bigint) as fp, cast(sum(gold_n) - sum(tp) as bigint) as fn"


def _joint(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, ord, key, tp, gold_n, pred_n per distinct atom, from the two multisets."""
    return scoring.joint(fx.spark_sql(spark, d, f"with li as ({fx.LINES}) {fx.EXPLODED_ITEMS}"), ["doc_id", "ord", "key", "atom"])


def _two_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    it = fx.spark_sql(spark, d, f"with li as ({fx.LINES}) {fx.EXPLODED_ITEMS}")
    side = lambda s: it.filter(F.col("side") == s).groupBy("doc_id", "ord", "key", "atom").agg(F.count(F.lit(1)).alias("n"))
    return side("gold"), side("pred")


@query(f"select * from ({_JOINT.replace('select doc_id, ord, key,', 'select doc_id, ord, key, atom,')})")
def score_overlap(spark, d):
    return scoring.overlap(*_two_sides(spark, d), ["doc_id", "ord", "key", "atom"])


@query(f"with c as (select key, {_TOTALS} from ({_JOINT}) group by key) select *, {_prf()}, tp + fn as gold_items, tp + fp as pred_items from c")
def score_flagship(spark, d):
    return scoring.per_key(scoring.counts(_joint(spark, d), ["key"]), digits=9)


@query(f"with c as (select doc_id, {_TOTALS} from ({_JOINT}) group by doc_id) select *, {_prf()} from c")
def score_micro_by_doc(spark, d):
    return scoring.micro(scoring.counts(_joint(spark, d), ["doc_id"]), ["doc_id"], 9)


@query(f"with c as (select {_TOTALS} from ({_JOINT})) select *, {_prf()} from c")
def score_micro_total(spark, d):
    return scoring.micro(scoring.counts(_joint(spark, d), []), digits=9)


@query(f"with c as (select (doc_id % 5) as fold, {_TOTALS} from ({_JOINT}) group by 1), s as (select sum(tp) as tp, sum(fp) as fp, sum(fn) as fn, count(*) as num_folds from c) select cast(num_folds as bigint) as num_folds, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(fn as bigint) as fn, {_prf()} from s")
def cv_pooled_micro(spark, d):
    folds = scoring.counts(_joint(spark, d).withColumn("fold", F.col("doc_id") % 5), ["fold"])
    return scoring.with_metrics(folds.agg(F.count(F.lit(1)).alias("num_folds"), *(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))), 9)


@query(f"with c as (select (doc_id % 5) as fold, key, {_TOTALS} from ({_JOINT}) group by 1, 2), s as (select key, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn from c group by key) select *, {_prf()}, tp + fn as gold_items, tp + fp as pred_items from s")
def cv_pooled_per_key(spark, d):
    return scoring.per_key(scoring.counts(_joint(spark, d).withColumn("fold", F.col("doc_id") % 5), ["fold", "key"]), digits=9)


@query("select case when k in ('TBB', 'TBLB') then 'TBB_TBLB' else k end as key, count(*) as n from (select case l_linenumber % 3 when 0 then 'TBB' when 1 then 'TBLB' else 'EGFR' end as k from {lineitem}) group by 1")
def score_eval_alias(spark, d):
    li = _table(spark, d, "lineitem")
    raw = F.when(F.col("l_linenumber") % 3 == 0, "TBB").when(F.col("l_linenumber") % 3 == 1, "TBLB").otherwise("EGFR")
    return li.groupBy(tx.eval_key(raw).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def _id_sides(spark, d):
    gold = _table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    pred = _table(spark, d, "lineitem").filter("l_discount > 0.01").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return gold, pred


_PRED_IDS = "(select distinct l_orderkey as id from {lineitem} where l_discount > 0.01)"


@query("select o_orderkey as id, o_totalprice, n from {orders} join (select l_orderkey, count(*) as n from {lineitem} where l_discount > 0.01 group by 1) on o_orderkey = l_orderkey")
def score_align_inner(spark, d):
    return align.aligned(*_id_sides(spark, d))


@query(f"select o_orderkey as id, o_totalprice from {{orders}} where o_orderkey not in (select id from {_PRED_IDS})")
def score_align_missing(spark, d):
    return align.unmatched(*_id_sides(spark, d))


@query(f"select id from {_PRED_IDS} where id not in (select o_orderkey from {{orders}})")
def score_align_extra(spark, d):
    gold, pred = _id_sides(spark, d)
    return align.unmatched(pred, gold).select("id")


@query(f"select 'both' as kind, count(*) as n from (select o_orderkey from {{orders}} intersect select id from {_PRED_IDS}) union all select 'gold', count(*) from (select o_orderkey from {{orders}} except select id from {_PRED_IDS}) union all select 'any', count(*) from (select o_orderkey from {{orders}} union select id from {_PRED_IDS})")
def id_sets(spark, d):
    g, p = (x.select("id") for x in _id_sides(spark, d))
    sets = [("both", g.intersect(p)), ("gold", g.exceptAll(p.distinct())), ("any", g.union(p).distinct())]
    out = [x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k, x in sets]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _event_items(spark, d):
    """Items of two sides; predicted events are in another order than the reference ones."""
    it = fx.spark_sql(spark, d, f"with li as ({fx.LINES}) {fx.EXPLODED_ITEMS}")
    return it.select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("side") == "pred", -F.col("ord")).otherwise(F.col("ord")).alias("ord"), "key", F.lit("str").alias("tag"), "atom", "side")


_MOST_EVENTS = 16


def _assignment_sql(pairs: str, docs: str) -> str:
    """(doc, best): the greatest total weight of an assignment, by dynamic programming over the sets of
    columns taken so far; pairs is (doc, i, j, w) with i and j from 1 to _MOST_EVENTS."""
    steps = [f"w as materialized ({pairs})", f"s0 as (select doc, 0 as mask, 0 as best from ({docs}))"]
    for k in range(1, _MOST_EVENTS + 1):
        grown = f"select s.doc, s.mask + (1 << w.j) as mask, s.best + w.w as best from s{k - 1} s join w on w.doc = s.doc and w.i = {k} where s.mask & (1 << w.j) = 0"
        steps.append(f"s{k} as (select doc, mask, max(best) as best from (select * from s{k - 1} union all {grown}) group by doc, mask)")
    return f"with {', '.join(steps)} select doc, max(best) as best from s{_MOST_EVENTS} group by doc"


_MATCHED_PAIRS = f"with li as ({fx.LINES}), it as ({fx.ITEMS}) select g.doc_id as doc, cast(g.ord as int) as i, cast(p.ord as int) as j, count(*) as w from it g join it p on g.doc_id = p.doc_id and g.key = p.key and g.atom = p.atom and g.side = 'gold' and p.side = 'pred' group by 1, 2, 3"
_SIDE_COUNTS = f"with li as ({fx.LINES}), it as ({fx.ITEMS}) select doc_id as doc, count_if(side = 'gold') as g, count_if(side = 'pred') as p from it group by 1 having g > 0 and p > 0"
_BY_DOC = f"with a as ({_assignment_sql(_MATCHED_PAIRS, f'select doc from ({_SIDE_COUNTS})')}), n as ({_SIDE_COUNTS}), c as (select cast(n.doc as varchar) as id, cast(best as bigint) as tp, cast(p - best as bigint) as fp, cast(g - best as bigint) as fn from n join a on a.doc = n.doc) select *, {_prf()} from c"


@query()
def score_hungarian_per_key(spark, d):
    return scoring.per_key(scoring.matched_items(_event_items(spark, d)), digits=9)


@query(_BY_DOC)
def score_hungarian_by_doc(spark, d):
    return scoring.micro(scoring.matched_items(_event_items(spark, d)), ["id"], 9)


_LABELS = "(values " + ", ".join("({}, {})".format(i, ", ".join("null" if x is None else f"'{x}'" for x in (label, *node))) for i, (label, node) in enumerate(schema.DIAGNOSES.items())) + ") as t(i, label, side, region, hist, special)"


@query(
    f"with l as (select * from {_LABELS}), c as (select c_custkey as id, cast(c_custkey % 53 as int) as gi, cast((c_custkey * 7 + 3) % 53 as int) as pi from {{customer}}) "
    "select id, g.label as gold, p.label as pred, (g.label = p.label or (g.special is null and p.special is null and (g.side is null or g.side is not distinct from p.side) and (g.region is null or g.region is not distinct from p.region) and (g.hist is null or g.hist is not distinct from p.hist))) as refines from c join l g on g.i = gi join l p on p.i = pi"
)
def hierarchy_refines(spark, d):
    labels = F.array(*(F.lit(x) for x in schema.DIAGNOSES))
    c = _table(spark, d, "customer").select(F.col("c_custkey").alias("id"), labels[(F.col("c_custkey") % 53).cast("int")].alias("gold"), labels[((F.col("c_custkey") * 7 + 3) % 53).cast("int")].alias("pred"))
    return c.withColumn("refines", hierarchy.refines(F.col("pred"), F.col("gold")))


@query(f"select label, side, region, hist, special from {_LABELS}")
def hierarchy_labels(spark, d):
    return hierarchy.label_table(spark)


_REFINES = "(g.label = p.label or (g.special is null and p.special is null and (g.side is null or g.side is not distinct from p.side) and (g.region is null or g.region is not distinct from p.region) and (g.hist is null or g.hist is not distinct from p.hist)))"
# Events of one or two units; the best pairing of two by two units is one of the two diagonals.
_UNITS = f"with li as ({fx.LINES}) select doc_id as doc, cast(floor((ord + 1) / 2) as int) as e, (ord + 1) % 2 as u, cast(l_partkey % 53 as int) as gi, cast((l_partkey + l_linenumber % 3 * 10) % 53 as int) as pi from li"
_UNIT_PAIRS = f"with u as ({_UNITS}), l as (select * from {_LABELS}), r as (select g.i as gi, p.i as pi from l g join l p on {_REFINES}) select a.doc, a.e as i, b.e as j, greatest(count_if(a.u = b.u), count_if(a.u <> b.u)) as w from u a join u b on a.doc = b.doc join r on r.gi = a.gi and r.pi = b.pi group by 1, 2, 3"
_HIERARCHICAL = f"with a as ({_assignment_sql(_UNIT_PAIRS, f'select distinct doc from ({_UNITS})')}), n as (select count(*) as n from ({_UNITS})), c as (select '{scoring.DIAGNOSIS}' as key, cast(sum(best) as bigint) as tp, cast(any_value(n) - sum(best) as bigint) as fp, cast(any_value(n) - sum(best) as bigint) as fn from a, n) select *, {_prf()}, tp + fn as gold_items, tp + fp as pred_items from c"


@query(_HIERARCHICAL)
def score_hierarchical(spark, d):
    """Documents of several diagnosis units per event, matched by refinement."""
    labels = F.array(*(F.lit(x) for x in schema.DIAGNOSES))
    li = fx.spark_sql(spark, d, fx.LINES).select(F.col("doc_id").cast("string").alias("id"), F.col("ord"), labels[(F.col("l_partkey") % 53).cast("int")].alias("g"), labels[((F.col("l_partkey") + F.col("l_linenumber") % 3 * 10) % 53).cast("int")].alias("p"))
    told = F.explode(F.array(*(F.struct(F.lit(side).alias("side"), F.col(c).alias("atom")) for side, c in (("gold", "g"), ("pred", "p")))))
    units = li.select("id", F.floor((F.col("ord") + 1) / 2).cast("int").alias("ord"), F.lit(scoring.DIAGNOSIS).alias("key"), F.lit("str").alias("tag"), told.alias("x"))
    return scoring.per_key(scoring.matched_items(units.select("id", "ord", "key", "tag", "x.atom", "x.side"), hierarchical=True), digits=9)


# ---- seeds, folds and resampling --------------------------------------------------------------
_BY_SEED = f"(with k as (select condition, seed, key, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from ({fx.DOC_KEYS}) group by 1, 2, 3), m as (select condition, seed, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from k group by 1, 2), a as (select condition, seed, round(avg({_f1('tp', 'fp', 'fn')}), 9) as macro_f1 from k group by 1, 2) select m.condition, m.seed, round({_f1('m.tp', 'm.fp', 'm.fn')}, 9) as micro_f1, macro_f1 from m join a on m.condition = a.condition and m.seed = a.seed)"


def _doc_keys(spark, d):
    return fx.spark_sql(spark, d, fx.DOC_KEYS)


def _stats_sql(c: str, digits: int = 9, lone: str = "coalesce(round(stddev_samp({c}), {n}), 0.0)") -> str:
    return f"round(avg({c}), {digits}) as {c}_mean, {lone.format(c=c, n=digits)} as {c}_std, round(min({c}), {digits}) as {c}_min, round(max({c}), {digits}) as {c}_max"


@query(f"select * from {_BY_SEED}")
def multiseed_by_seed(spark, d):
    return analytics.overall_by_seed(_doc_keys(spark, d))


@query(f"select condition, {_stats_sql('micro_f1', 6)}, {_stats_sql('macro_f1', 6)} from {_BY_SEED} group by condition")
def multiseed_overall(spark, d):
    return analytics.stats(analytics.overall_by_seed(_doc_keys(spark, d)), ["condition"], ["micro_f1", "macro_f1"], 6)


@query(f"with k as (select condition, seed, key, round({_f1('sum(tp)', 'sum(fp)', 'sum(fn)')}, 9) as f1 from ({fx.DOC_KEYS}) group by 1, 2, 3) select condition, key, {_stats_sql('f1', 6)} from k group by 1, 2")
def multiseed_per_key(spark, d):
    each = scoring.per_key(_doc_keys(spark, d), ["condition", "seed"], 9)
    return analytics.stats(each, ["condition", "key"], ["f1"], 6)


@query(f"with k as (select condition, key, {_f1('sum(tp)', 'sum(fp)', 'sum(fn)')} as f1 from ({fx.DOC_KEYS}) group by 1, 2) select condition, round(avg(f1), 9) as macro_f1, count(*) as n_keys from k group by 1")
def macro_f1(spark, d):
    return scoring.macro(scoring.per_key(_doc_keys(spark, d), ["condition"]), ["condition"])


@query(f"with x as ({fx.DOC_KEYS}), g as (select * from (select distinct condition, seed, doc_id from x) cross join (select distinct key from x)), s as (select condition, seed, doc_id, key, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from x group by 1, 2, 3, 4) select g.condition, g.seed, g.doc_id, g.key, cast(coalesce(tp, 0) as bigint) as tp, cast(coalesce(fp, 0) as bigint) as fp, cast(coalesce(fn, 0) as bigint) as fn from g left join s on g.condition = s.condition and g.seed = s.seed and g.doc_id = s.doc_id and g.key = s.key")
def doc_key_counts_dense(spark, d):
    return analytics.dense_counts(_doc_keys(spark, d))


@query(f"with k as (select condition, key, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from ({fx.DOC_KEYS}) where condition in ('zero_shot', 'ft_all') group by 1, 2), m as (select condition, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from k group by 1), a as (select condition, round(avg({_f1('tp', 'fp', 'fn')}), 9) as macro_f1, count(*) as n_keys from k group by 1) select m.condition, {_prf('m.tp', 'm.fp', 'm.fn', 'micro_')}, macro_f1, n_keys from m join a on m.condition = a.condition")
def few_shot_overall(spark, d):
    return analytics.few_shot_overall(_doc_keys(spark, d), ["zero_shot", "ft_all"])


@query(f"with k as (select key, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from ({fx.DOC_KEYS}) where condition = 'ft_all' group by 1) select key as item, cast(tp + fn as bigint) as reference_instances, {_prf()} from k")
def few_shot_per_item(spark, d):
    return analytics.per_item(_doc_keys(spark, d), "ft_all")


_PER_FOLD = f"(with k as (select condition, seed, fold, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn, count(distinct doc_id) as n_eval from ({fx.DOC_KEYS}) group by 1, 2, 3) select condition, seed, fold, 96 - n_eval as n_train, n_eval, cast(tp + fn as bigint) as gold_items, {_prf(prefix='micro_')} from k)"


@query(f"select * from {_PER_FOLD}")
def per_fold(spark, d):
    return analytics.per_fold(_doc_keys(spark, d), 96)


@query(f"with a as (select seed, doc_id, min(fold) as fold from ({fx.DOC_KEYS}) group by 1, 2), n as (select doc_id, count(distinct fold) as n from a group by 1) select count(*) as documents, count_if(n = 1) as stable, bool_and(n = 1) as identical from n")
def fold_stability(spark, d):
    return analytics.fold_stability(_doc_keys(spark, d))


@query("select condition, seed, " + ", ".join(f"round(avg(case when fold = '{i}' then micro_f1 end), 3) as \"{i}\"" for i in range(5)) + f" from {_PER_FOLD} group by 1, 2")
def fold_pivot(spark, d):
    return analytics.fold_pivot(analytics.per_fold(_doc_keys(spark, d), 96), [str(i) for i in range(5)])


@query(f"select condition, {_stats_sql('micro_f1', 4, 'round(stddev_samp({c}), {n})')} from {_PER_FOLD} group by condition")
def fold_summary(spark, d):
    return analytics.stats(analytics.per_fold(_doc_keys(spark, d), 96), ["condition"], ["micro_f1"], 4, lone_deviation_zero=False)


_RESAMPLED = (
    f"(with x as ({fx.DOC_KEYS}), w as (select doc_id, b, cast(('0x' || substr(md5(doc_id || '-' || cast(b as varchar)), 1, 6)) as bigint) % 3 as w from (select distinct doc_id from x), (select unnest(range(40)) as b)), "
    f"k as (select condition, seed, b, key, sum(tp * w) as tp, sum(fp * w) as fp, sum(fn * w) as fn from x join w using (doc_id) group by 1, 2, 3, 4), "
    f"s as (select condition, seed, b, round({_f1('sum(tp)', 'sum(fp)', 'sum(fn)')}, 9) as micro, round(coalesce(avg(case when tp + fp + fn > 0 then {_f1('tp', 'fp', 'fn')} end), 0.0), 9) as macro from k group by 1, 2, 3), "
    "m as (select condition, b, avg(micro) as micro, avg(macro) as macro from s group by 1, 2) select * from m)"
)


def _resampled(spark, d):
    x = _doc_keys(spark, d)
    return resampling.weighted_scores(x, resampling.hash_weights(x, 40))


@query(f"with m as (select * from {_RESAMPLED}), t as (select condition, 'micro_f1' as metric, micro as x from m union all select condition, 'macro_f1', macro from m) select condition, metric, round(quantile_cont(x, 0.025), 6) as ci_low, round(quantile_cont(x, 0.975), 6) as ci_high from t group by 1, 2")
def bootstrap_ci_small(spark, d):
    return resampling.intervals(_resampled(spark, d), 6)


@query(f"with m as (select * from {_RESAMPLED}), p as (select a.b, round(a.micro - z.micro, 6) as micro_f1, round(a.macro - z.macro, 6) as macro_f1 from m a join m z on a.b = z.b and a.condition = 'ft_all' and z.condition = 'zero_shot'), t as (select 'micro_f1' as metric, micro_f1 as d from p union all select 'macro_f1', macro_f1 from p), s as (select metric, round(quantile_cont(d, 0.025), 6) as ci_low, round(quantile_cont(d, 0.975), 6) as ci_high, avg(case when d <= 0 then 1.0 else 0.0 end) as lo, avg(case when d >= 0 then 1.0 else 0.0 end) as hi from t group by 1) select metric, ci_low, ci_high, least(1.0, round(2 * least(lo, hi), 6)) as p_two_sided, (ci_low > 0 or ci_high < 0) as excludes_zero from s")
def paired_diff_small(spark, d):
    return resampling.differences(_resampled(spark, d), "ft_all", "zero_shot", 6)


@query()
def bootstrap_ci_full(spark, d):
    return resampling.intervals(resampling.bootstrap(spark, _doc_keys(spark, d), 10_000).withColumn("seed", F.lit("all")), 6)


@query()
def permutation_test(spark, d):
    return resampling.permutation(spark, _doc_keys(spark, d), [("ft_all", "zero_shot"), ("ft_all", "ft_mock")], 10_000)


# ---- event lists ------------------------------------------------------------------------------
def _spread(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows dealt over all tasks, as files would be: what is done with them costs far more than moving them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


# Lines are dealt once, by document and over all tasks: what is done with event lists costs far more than moving lines.
def _annotations(spark, d):
    return fx.spark_sql(spark, d, fx.ANNOTATIONS["spark"], deal="l_orderkey")


def _damaged(spark, d):
    return fx.spark_sql(spark, d, f"{fx.DAMAGE} ({fx.ANNOTATIONS['spark']})", deal="l_orderkey")


def _clean_stages(spark, d):
    notes = _annotations(spark, d).select(F.col("doc_id").alias("id"), F.lit("右上葉に結節").alias("progress_note"))
    told = _damaged(spark, d).select(F.col("doc_id").alias("id"), F.col("raw").alias("annotation"))
    return cleaning.clean(notes, told, list(schema.PROMPT_KEYS), CANDIDATES)


@query("with n as (select l_orderkey as doc_id, count(*) as n from {lineitem} group by 1) select doc_id, case doc_id % 8 when 0 then 'ok' when 6 then 'ok' when 7 then 'failed' else 'lenient' end as status, cast(case doc_id % 8 when 5 then 0 when 6 then 2 * n when 7 then 0 else n end as bigint) as n_events from n")
def lenient_parse(spark, d):
    parsed = _damaged(spark, d).select("doc_id", lj.parse_events(F.col("raw")).alias("p"))
    return parsed.select("doc_id", F.col("p.status").alias("status"), F.size("p.events").cast("bigint").alias("n_events"))


# What a damaged text still tells of each line: of 3, an object's last key is lost; of 4, the size;
# of 5 and 7 all; in 6 all events stand twice.
_TOLD = f"with li as ({fx.LINES}) select doc_id, ord, '\"Timestamp\": \"' || substr(cast(l_shipdate as varchar), 1, 10) || '\"' as ts, case when doc_id % 8 <> 4 then '\"TumorSize\": ' || cast(cast(l_quantity as bigint) as varchar) end as size, '\"Recurrence\": \"' || case l_returnflag when 'R' then 'あり' else 'なし' end || '\"' as rec, case when doc_id % 8 = 3 and l_suppkey % 4 <> 0 then null else case l_linenumber % 3 when 0 then '手術, 化学療法' when 1 then '手術、放射線療法' else '未知療法' end end as treat, l_suppkey % 4 = 0 and doc_id % 8 <> 3 as unknown, case doc_id % 8 when 6 then 2 else 1 end as times from li where doc_id % 8 not in (5, 7)"
_TOLD_TEXTS = f"select doc_id, ord, concat('{{{{', array_to_string(list_filter([ts, size, rec, '\"Treatment\": \"' || treat || '\"', case when unknown then '\"UnknownKey\": \"x\"' end], lambda x: x is not null), ', '), '}}}}') as t from ({_TOLD})"
_CANONICAL = f"with t as (select doc_id, t, min(ord) as o from ({_TOLD_TEXTS}) group by 1, 2) select doc_id, concat('[', string_agg(t, ', ' order by o), ']') as pred_annotation from t group by doc_id union all select distinct l_orderkey, '[]' from {{lineitem}} where l_orderkey % 8 in (5, 7)"
_CLEANED = f"select doc_id, concat('{{{{', array_to_string(list_filter([ts, size, rec, '\"Treatment\": \"' || case treat when '手術、放射線療法' then '手術, 放射線療法' when '手術, 化学療法' then treat end || '\"'], lambda x: x is not null), ', '), '}}}}') as t, ord, treat, unknown, times from ({_TOLD})"


@query(_CANONICAL)
def canonicalize_prediction(spark, d):
    return _damaged(spark, d).select("doc_id", lj.canonicalize_prediction(F.col("raw"), 64).alias("pred_annotation"))


_CAPPED = f"with t as (select doc_id, t, min(ord) as o from ({_TOLD_TEXTS}) group by 1, 2), r as (select *, row_number() over (partition by doc_id order by o) as r from t) select doc_id, concat('[', string_agg(t, ', ' order by o), ']') as pred_annotation from r where r <= 2 group by doc_id union all select distinct l_orderkey, '[]' from {{lineitem}} where l_orderkey % 8 in (5, 7)"


@query(_CAPPED)
def canonicalize_capped(spark, d):
    return _damaged(spark, d).select("doc_id", lj.canonicalize_prediction(F.col("raw"), 2).alias("pred_annotation"))


_EVENT_ITEMS = (
    f"with li as ({fx.LINES}), x as (select doc_id, ord, 'Timestamp' as key, 'str' as tag, [substr(cast(l_shipdate as varchar), 1, 10)] as atoms from li union all select doc_id, ord, 'TumorSize', 'num_int', [cast(cast(l_quantity as bigint) as varchar)] from li "
    "union all select doc_id, ord, 'Recurrence', 'str', [case l_returnflag when 'R' then 'あり' else 'なし' end] from li union all select doc_id, ord, 'Treatment', 'str', case l_linenumber % 3 when 0 then ['手術', '化学療法'] when 1 then ['手術', '放射線療法'] else ['未知療法'] end from li "
    "union all select doc_id, ord, 'UnknownKey', 'str', ['x'] from li where l_suppkey % 4 = 0) select doc_id as id, cast(ord - 1 as int) as ord, key, tag, unnest(atoms) as atom, cast(1 as bigint) as n from x"
)


@query(_EVENT_ITEMS)
def event_items(spark, d):
    """Entries of all events as normalised atoms."""
    parsed = _annotations(spark, d).select(F.col("doc_id").alias("id"), lj.parse_events(F.col("annotation"))["events"].alias("events"))
    return scoring.items(parsed)


@query(f"with t as (select doc_id, t, min(ord) as o from ({_CLEANED}) group by 1, 2) select doc_id as id, '右上葉に結節' as progress_note, concat('[', string_agg(t, ', ' order by o), ']') as annotation from t group by doc_id")
def clean_pipeline(spark, d):
    return cleaning.cleaned(_clean_stages(spark, d))


@query(
    f"with c as ({_CLEANED}), n as (select distinct l_orderkey as doc_id from {{lineitem}}), k as (select doc_id, sum(times) as events, count(distinct t) as kept from c group by 1) "
    "select (select count(*) from n) as annotated, (select count_if(doc_id % 8 = 7) from n) as parse_error, (select count_if(doc_id % 8 = 5) from n) as empty, (select count_if(doc_id % 8 not in (5, 7)) from n) as clean_rows, "
    "cast(sum(case when unknown then times else 0 end) as bigint) as unknown_keys, cast(0 as bigint) as events_after_unknown, cast(sum(case when treat = '未知療法' then times else 0 end) as bigint) as other_value_tokens, "
    "cast(sum(case when treat = '未知療法' then times else 0 end) as bigint) as keys_after_values, cast(0 as bigint) as events_after_values, cast(0 as bigint) as timestamp_only_events, (select cast(sum(events - kept) as bigint) from k) as repeated_events from c"
)
def clean_counters(spark, d):
    return cleaning.counters(_clean_stages(spark, d), CANDIDATES)


@query(f"select 'Treatment' as key, cast(sum(times) as bigint) as dropped from ({_CLEANED}) where treat = '未知療法'")
def clean_dropped_tokens(spark, d):
    return cleaning.dropped_tokens_by_key(_clean_stages(spark, d), CANDIDATES)


_EV = f"({fx.EVENT_TEXTS})"


@query(f"select doc_id, count(*) as n_events, count(distinct ev) as kept from {_EV} group by doc_id")
def clean_dedupe(spark, d):
    events = _annotations(spark, d).select("doc_id", lj.parse_events(F.col("annotation"))["events"].alias("e"))
    return events.select("doc_id", F.size("e").cast("bigint").alias("n_events"), F.size(cleaning.dedupe(F.col("e"))).cast("bigint").alias("kept"))


@query("select l_orderkey as doc_id, count(*) as n_events, sum(case when l_suppkey % 4 = 0 then 1 else 0 end) as dropped from {lineitem} group by 1")
def clean_unknown_keys(spark, d):
    events = _annotations(spark, d).select("doc_id", lj.parse_events(F.col("annotation"))["events"].alias("e"))
    count = lambda c: F.size(F.flatten(F.transform(c, lambda ev: ev["entries"])))
    kept = cleaning.drop_unknown_keys(F.col("e"), list(schema.PROMPT_KEYS))
    return events.select("doc_id", F.size(kept).cast("bigint").alias("n_events"), (count(F.col("e")) - count(kept)).cast("bigint").alias("dropped"))


@query("select l_orderkey as doc_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, case l_linenumber % 3 when 0 then '手術, 化学療法' when 1 then '手術, 放射線療法' end as treatment from {lineitem}")
def clean_candidate_values(spark, d):
    raw = F.when(F.col("l_linenumber") % 3 == 0, "手術, 化学療法, 手術").when(F.col("l_linenumber") % 3 == 1, "手術、放射線療法、未知療法").otherwise("未知療法")
    entry = F.struct(F.lit("Treatment").alias("key"), F.lit("str").alias("jtype"), raw.alias("raw"), F.lit(None).cast("array<string>").alias("items"))
    kept = cleaning.keep_candidates(entry, CANDIDATES)
    return _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.when(F.size(kept) > 0, F.array_join(kept, ", ")).alias("treatment"))


@query("select l_orderkey as doc_id, count_if(l_suppkey % 3 <> 0) as kept from {lineitem} group by 1")
def clean_timestamp_only(spark, d):
    li = fx.spark_sql(spark, d, "select l_orderkey as doc_id, concat('{{\"Timestamp\": \"2025-01-01\"', case when l_suppkey % 3 <> 0 then ', \"Stage\": \"StageⅠ\"' else '' end, '}}') as ev from {lineitem}")
    texts = li.groupBy("doc_id").agg(F.concat(F.lit("["), F.array_join(F.collect_list("ev"), ", "), F.lit("]")).alias("annotation"))
    events = lj.parse_events(F.col("annotation"))["events"]
    return texts.select("doc_id", F.size(cleaning.drop_timestamp_only(events)).cast("bigint").alias("kept"))


_SITE_NOTES = "select c_custkey as id, concat('所見: ', case c_custkey % 6 when 0 then '右上葉に結節' when 1 then '右上葉と右下葉' when 2 then '右S1+2' when 3 then '右S6 に陰影' when 4 then '#10R 腫大' else '異常なし' end, ' ', c_name) as note from {customer}"


@query(f"select id, case id % 6 when 0 then '右肺上葉' when 3 then '右肺下葉' when 4 then '右肺門部' end as site from ({_SITE_NOTES})")
def infer_site(spark, d):
    return fx.spark_sql(spark, d, _SITE_NOTES).select("id", cleaning.infer_site(F.col("note"), "右").alias("site"))


@query("select c_custkey as id, case c_custkey % 6 when 0 then '左肺上葉' when 2 then '左肺上葉' when 3 then '左肺下葉' when 4 then '左肺門部' end as site from {customer}")
def infer_site_left(spark, d):
    notes = fx.spark_sql(spark, d, _SITE_NOTES.replace("右", "左").replace("#10R", "#10L"))
    return notes.select("id", cleaning.infer_site(F.col("note"), "左").alias("site"))


@query(f"select id, concat('肺, ', case id % 6 when 0 then '右肺上葉' when 3 then '右肺下葉' when 4 then '右肺門部' else '' end) as site from ({_SITE_NOTES}) where id % 6 in (0, 3, 4) union all select id, '肺' from ({_SITE_NOTES}) where id % 6 not in (0, 3, 4)")
def clean_site(spark, d):
    events = lj.parse_events(F.lit('[{"Site": "左肺, 右肺 , 左肺"}]'))["events"]
    notes = fx.spark_sql(spark, d, _SITE_NOTES).withColumn("e", events)
    return notes.select("id", cleaning.normalize_sites(F.col("e"), F.col("note"))[0]["entries"][0]["raw"].alias("site"))


_PRESENT = f"(select doc_id as id, 'Timestamp' as key from {_EV} union select doc_id, 'TumorSize' from {_EV} union select doc_id, 'Recurrence' from {_EV} union select doc_id, 'Treatment' from {_EV})"


def _present(spark, d):
    parsed = _annotations(spark, d).select(F.col("doc_id").alias("id"), lj.parse_events(F.col("annotation"))["events"].alias("events"))
    return cleaning.keys_present(parsed)


@query("select id, " + ", ".join(f"max(case when key = '{k}' then 1 else 0 end) as {k}" for k in ("Timestamp", "TumorSize", "Recurrence", "Treatment", "Stage")) + f" from {_PRESENT} group by id")
def key_presence_matrix(spark, d):
    return cleaning.presence_matrix(_present(spark, d), ["Timestamp", "TumorSize", "Recurrence", "Treatment", "Stage"])


@query(f"select cast(id % 5 as bigint) as fold, key, count(distinct id) as documents from {_PRESENT} group by 1, 2")
def item_document_counts(spark, d):
    return _present(spark, d).groupBy((F.col("id") % 5).alias("fold"), "key").agg(F.count_distinct("id").alias("documents"))


@query()
def score_events(spark, d):
    """Parsed, damaged predictions against whole references, with optimal alignment."""
    gold = _annotations(spark, d).select(F.col("doc_id").alias("id"), F.col("annotation").alias("text"))
    pred = _damaged(spark, d).select(F.col("doc_id").alias("id"), F.col("raw").alias("text"))
    return scoring.per_key(scoring.score_texts(gold, pred, hierarchical=True), digits=9)


# ---- scalar functions -------------------------------------------------------------------------
@query(
    f"select id, case id % 8 when 4 then strftime(o_orderdate, '%Y-%m') when 5 then strftime(o_orderdate, '%Y-%m') when 6 then strftime(o_orderdate, '%Y') when 7 then '不明' || strftime(o_orderdate, '%Y') else strftime(o_orderdate, '%Y-%m-%d') end as date_text from ({fx.DATES})"
)
def normalize_date(spark, d):
    return fx.spark_sql(spark, d, fx.DATES).select("id", tx.normalize_date(F.col("raw_date")).alias("date_text"))


@query(f"select id, array_to_string(list_filter(list_transform(regexp_split_to_array(translate(raw_list, '、，＋､', ',,+,'), '[,+]+'), lambda x: trim(x)), lambda x: x <> ''), '|') as tokens from ({fx.LISTS})")
def split_list_tokens(spark, d):
    return fx.spark_sql(spark, d, fx.LISTS).select("id", F.array_join(tx.split_list_tokens(F.col("raw_list")), "|").alias("tokens"))


@query(f"select id, array_to_string(list_filter(list_transform(regexp_split_to_array(raw_list, '[,、，]+'), lambda x: trim(x)), lambda x: x <> ''), '|') as tokens from ({fx.LISTS})")
def split_value_tokens(spark, d):
    return fx.spark_sql(spark, d, fx.LISTS).select("id", F.array_join(tx.split_value_tokens(F.col("raw_list")), "|").alias("tokens"))


@query("select p_partkey as id, cast(round_even(p_size / 2.0, 0) as bigint) as half, cast(p_size as varchar) || 'mm' as sized from {part}")
def normalize_number(spark, d):
    none = F.lit(None)
    one = lambda jtype, raw: tx.normalize_atoms(F.lit("TumorSize"), F.lit(jtype), raw, none.cast("array<string>"), none.cast("string"))[0]["atom"]
    p = _table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), one("float", (F.col("p_size") / 2).cast("string")).cast("bigint").alias("half"), one("str", F.concat(F.col("p_size").cast("string"), F.lit("mm"))).alias("sized"))


@query("select format('{{:.1f}}', cast(l_discount as double) * cast(l_quantity as double)) as atom, count(*) as n from {lineitem} group by 1")
def normalize_number_float(spark, d):
    raw = _table(spark, d, "lineitem").select((F.col("l_discount") * F.col("l_quantity")).cast("string").alias("raw"))
    told = raw.select("raw", tx.round_tenth(F.col("raw")).alias("tenth"))  # Python's part goes before: no lambda may hold it
    atoms = tx.normalize_atoms(F.lit("PDL1"), F.lit("str"), F.col("raw"), F.lit(None).cast("array<string>"), F.col("tenth"))
    return told.groupBy(atoms[0]["atom"].alias("atom")).agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id as id, cast(xor(42, cast(('0x' || substr(md5(cast(doc_id as varchar)), 1, 8)) as bigint)) as bigint) as seed from {documents}")
def icl_seed(spark, d):
    return _table(spark, d, "documents").select(F.col("doc_id").alias("id"), tx.id_seed(42, F.col("doc_id").cast("string")).alias("seed"))


_STRIP = "regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"


@query(f"select id, case when role = 'assistant' then {_STRIP.format(x='text')} else '' end as final_text, role = 'assistant' as found from ({fx.CHANNELS})")
def final_channel(spark, d):
    text, found = tx.final_channel(F.col("raw_pred_annotation"))
    return fx.spark_sql(spark, d, fx.CHANNELS).select("id", text.alias("final_text"), found.alias("found"))


@query(f"select id, case when role = 'assistant' then {_STRIP.format(x='text')} else " + _STRIP.format(x="regexp_replace(raw_pred_annotation, '<\\|(start|end|message|channel|return|call|constrain|endoftext)\\|>', ' ', 'g')") + f" end as text from ({fx.CHANNELS})")
def fallback_text(spark, d):
    return fx.spark_sql(spark, d, fx.CHANNELS).select("id", tx.channel_text(F.col("raw_pred_annotation"))[0].alias("text"))


@query(f"select id, {_STRIP.format(x='text')} as text from ({fx.CHANNELS})")
def strip_thoughts(spark, d):
    raw = F.concat(F.lit("<think>a\nb</think> "), F.col("text"), F.lit("<thinking>"), F.col("role"), F.lit("</thinking>"))
    return fx.spark_sql(spark, d, fx.CHANNELS).select("id", tx.strip_thoughts(raw).alias("text"))


@query(f"select id, raw_pred_annotation, role = 'assistant' as final_channel_found, '[]' as pred_annotation from ({fx.CHANNELS})")
def reparse_predictions(spark, d):
    return generation.reparse(fx.spark_sql(spark, d, fx.CHANNELS).select("id", "raw_pred_annotation"))


@query("select doc_id as id, '### Note:' || chr(10) || text || chr(10) || '### Events:' as prompt from {documents}")
def render_prompt(spark, d):
    return _table(spark, d, "documents").select(F.col("doc_id").alias("id"), tx.render_prompt(TEMPLATE, F.col("text")).alias("prompt"))


@query("select doc_id as id, lang || chr(10) || chr(10) || 'Read.' || chr(10) || chr(10) || '### 入力:' || chr(10) || text as prompt from {documents}")
def render_context(spark, d):
    return _table(spark, d, "documents").select(F.col("doc_id").alias("id"), tx.render_prompt("Read.", F.col("text"), F.col("lang")).alias("prompt"))


@query("select doc_id as id, 'List every event as JSON.' || chr(10) || chr(10) || '### Input:' || chr(10) || text || chr(10) || chr(10) || '### Output:' || chr(10) || source || '</s>' as training_text, '[System]' || chr(10) || 'Extract events.' || chr(10) || chr(10) || '[User]' || chr(10) || text || chr(10) || chr(10) || '[Assistant]' || chr(10) as chat_text from {documents}")
def training_texts(spark, d):
    return _table(spark, d, "documents").select(F.col("doc_id").alias("id"), tx.training_text(GUIDELINE, F.col("text"), F.col("source"), "</s>").alias("training_text"), tx.chat_text(SYSTEM, F.col("text")).alias("chat_text"))


@query("select doc_id as id, 'List every event as JSON.' || chr(10) || chr(10) || '### Input:' || chr(10) || coalesce(text, '') || chr(10) || chr(10) || '### Output:' || chr(10) as prompt, '【例1】' || chr(10) || lang || chr(10) || chr(10) || '【例2】' || chr(10) || coalesce(text, '') as examples, '【例1の入力】' || chr(10) || source as labelled from {documents}")
def structured_prompts(spark, d):
    text = F.coalesce("text", F.lit(""))
    told = [tx.render_structured(GUIDELINE, text).alias("prompt"), tx.render_examples(F.array("lang", text)).alias("examples"), tx.render_examples(F.array("source"), "入力").alias("labelled")]
    return _table(spark, d, "documents").select(F.col("doc_id").alias("id"), *told)


@query("select p_partkey as id, array_to_string(list_transform(range(1, cast(p_size as bigint) + 1), lambda x: case when p_size >= 8 and x <= 8 then -100 else x end), ',') as labels, array_to_string(list_transform(range(1, 33), lambda x: case when x <= p_size then x else -100 end), ',') as padded from {part}")
def label_masks(spark, d):
    ids = F.sequence(F.lit(1), F.col("p_size"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return _spread(_table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").select(F.col("p_partkey").alias("id"), text(tx.mask_labels(ids, [[7, 8]])).alias("labels"), text(tx.pad_labels(ids, F.lit(32))).alias("padded"))


# ---- rows, joins and slices -------------------------------------------------------------------
@query("select count(*) as total, count_if(text is not null and trim(text) <> '') as kept, count_if(text is null or trim(text) = '') as missing from {documents}")
def missing_counter(spark, d):
    return align.missing_counter(_table(spark, d, "documents"), ["doc_id", "text"])


@query("select doc_id as id, text as progress_note, quality as annotation from {documents} join {labels} using (doc_id)")
def pair_by_id(spark, d):
    notes = _table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("progress_note"))
    return align.pair_by_id(notes, _table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("annotation")))


@query("select l_orderkey as id, max(l_shipdate) as last_ship, arg_max(l_extendedprice, (l_shipdate, l_extendedprice)) as price from {lineitem} group by 1")
def pair_last_wins(spark, d):
    li = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("last_ship"), F.col("l_extendedprice").alias("price"))
    return align.last_wins(li, "id", F.struct("last_ship", "price"))


@query("select l_orderkey as id, l_linenumber, l_extendedprice, o_orderpriority from {lineitem} join {orders} on l_orderkey = o_orderkey")
def probe_join(spark, d):
    li = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_extendedprice")
    return align.probe(li, _table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority"))


@query("select doc_id as id, lang from {documents} where doc_id not in (select doc_id from {labels})")
def resume_anti(spark, d):
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    return align.unmatched(docs, _table(spark, d, "labels").select(F.col("doc_id").alias("id")))


@query("select doc_id, lang, doc_id in (select doc_id from {labels}) as labelled from {documents}")
def member_rows(spark, d):
    """Rows whose id is in a set, and the others."""
    docs, known = _table(spark, d, "documents").select("doc_id", "lang"), _table(spark, d, "labels").select("doc_id")
    inside, outside = align.members(docs, known, "doc_id"), align.members(docs, known, "doc_id", keep=False)
    return inside.withColumn("labelled", F.lit(True)).unionByName(outside.withColumn("labelled", F.lit(False)))


@query("select o_orderkey, o_totalprice from {orders} order by o_orderkey limit 500 offset 250")
def slice_range(spark, d):
    return align.slice_rows(_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 250, 750)


@query("select doc_id, cast(floor(rank / ceil(total / 4.0)) as int) as shard from (select doc_id, row_number() over (order by doc_id) - 1 as rank, count(*) over () as total from {documents})")
def shard_assign(spark, d):
    docs = _table(spark, d, "documents").select("doc_id")
    ranked = align.with_rank(docs, "doc_id")
    return ranked.select("doc_id", align.shard_of(F.col("rank"), docs.count(), 4).alias("shard"))


@query("select doc_id, text, lang from {documents} order by length(text) desc, doc_id limit 20")
def topk_longest(spark, d):
    docs = _table(spark, d, "documents").withColumn("length", F.length("text"))
    return analytics.longest(docs, "length", "doc_id", 20).select("doc_id", "text", "lang")


_LENGTHS = "(select doc_id, length(text) as len from {documents})"


@query(f"with x as (select * from {_LENGTHS}), e as (select min(len) as lo, max(len) as hi from x) select count(*) as n, " + ", ".join(f"cast(floor(quantile_cont(len, {q / 100})) as int) as p{q}" for q in (50, 90, 95, 99)) + f", min(len) as min_len, (select string_agg(cast(doc_id as varchar), ';' order by doc_id) from x where len = (select lo from e)) as min_ids, max(len) as max_len, (select string_agg(cast(doc_id as varchar), ';' order by doc_id) from x where len = (select hi from e)) as max_ids, count_if(len > 4000) as over, round(count_if(len > 4000) / count(*), 9) as over_ratio from x")
def length_percentiles(spark, d):
    docs = generation.token_lengths(_table(spark, d, "documents"), "text")
    return analytics.length_stats(docs.select("doc_id", F.col("length").cast("bigint").alias("length")), "length", "doc_id", 4000)


@query("select o_orderkey as id, o_totalprice, row_number() over (order by o_orderkey) - 1 as place from {orders}")
def sort_numeric_id(spark, d):
    """A file of ids as text, sorted in its place by their numbers and read again by line."""
    path = files.scratch(spark, "sorted")
    rows = _table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), "o_totalprice")
    files.write_jsonl(rows.repartition(3), path)
    files.replace_sorted(files.read_jsonl(spark, path, "id string, o_totalprice double"), path)
    back = files.read_jsonl(spark, path, "id string, o_totalprice double", numbered=True)
    return back.select(F.col("id").cast("bigint").alias("id"), "o_totalprice", (F.col("line_no") - 1).alias("place"))


@query("select told as name, row_number() over (order by told, p_partkey) - 1 as place, p_partkey from (select p_partkey, 'http://host/' || p_type || '/' || p_brand as told from {part})")
def rank_text_ids(spark, d):
    """Ranks by text ids that share a long beginning."""
    part = _table(spark, d, "part").select(F.concat(F.lit("http://host/"), "p_type", F.lit("/"), "p_brand").alias("name"), "p_partkey")
    ordered = part.withColumn("key", F.concat("name", F.lit(" "), F.lpad(F.col("p_partkey").cast("string"), 12, "0")))
    return align.with_rank(ordered, "key", "place").select("name", "place", "p_partkey")


@query("select doc_id, row_number() over (order by doc_id % 12, doc_id) - 1 as place from {documents}")
def merge_shards(spark, d):
    """Twelve shard files merged in the order of their numbers: shard_2 before shard_10."""
    docs, base = _table(spark, d, "documents").select("doc_id"), files.scratch(spark, "shards")
    shard = F.concat(F.lit("shard_"), (F.col("doc_id") % 12).cast("string"))
    docs.withColumn("shard", shard).repartition(4, "shard").sortWithinPartitions("shard", "doc_id").write.partitionBy("shard").json(base)
    named = files.version_key(F.col("shard"))
    lines = spark.read.schema("doc_id bigint, shard string").json(base)
    return align.with_rank(lines.withColumn("key", F.concat(named, F.lit(" "), F.lpad(F.col("doc_id").cast("string"), 20, "0"))), "key", "place").select("doc_id", "place")


@query("select doc_id, cast(doc_id % 5 as int) as fold from {documents}")
def fold_map(spark, d):
    base = files.scratch(spark, "folds")
    _table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), (F.col("doc_id") % 5).alias("fold")).write.partitionBy("fold").json(base)
    return files.read_fold_map(spark, base).select(F.col("id").cast("bigint").alias("doc_id"), "fold")


@query("select conv_id, turn, role, " + "regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')" + " as text from {conversations} where trim(text) <> '' and trim(role) <> ''")
def prepared_rows(spark, d):
    rows = _table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit(" "), "role", F.lit("\n")).alias("role"), F.concat(F.lit("\t "), "text", F.lit(" ")).alias("text"))
    return align.prepared(rows, ["role", "text"])


@query("select o_orderkey, o_totalprice from {orders} order by o_orderkey limit 100")
def head_rows(spark, d):
    return align.head_rows(_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100)


def _dry_run(spark, d):
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return generation.preview(docs, _table(spark, d, "labels").select(F.col("doc_id").alias("id")), TEMPLATE, 5)


@query("select doc_id as id, '### Note:' || chr(10) || text || chr(10) || '### Events:' as prompt from {documents} where text is not null and doc_id not in (select doc_id from {labels}) order by doc_id limit 5")
def dry_run_prompts(spark, d):
    return _dry_run(spark, d)[0]


@query("select count(*) as total, count_if(l.doc_id is not null) as done, count_if(l.doc_id is null and text is null) as missing, count_if(l.doc_id is null and text is not null) as todo from {documents} d left join (select distinct doc_id from {labels}) l on d.doc_id = l.doc_id")
def dry_run_counters(spark, d):
    return _dry_run(spark, d)[1]


@query(f"with p as (select condition, seed, {', '.join(f'round(avg(case when fold = {chr(39)}{i}{chr(39)} then micro_f1 end), 3) as f{i}' for i in range(5))} from {_PER_FOLD} group by 1, 2) select row_number() over (order by condition, seed) - 1 as place, * from p")
def report_order(spark, d):
    """A report table written in its stated order and read back by line."""
    path, names = files.scratch(spark, "report"), [str(i) for i in range(5)]
    table = analytics.fold_pivot(analytics.per_fold(_doc_keys(spark, d), 96), names)
    told = table.select(F.to_json(F.struct("condition", "seed", *(F.col(x).alias(f"f{x}") for x in names))).alias("value"), "condition", "seed")
    told.orderBy("condition", "seed").select("value").write.text(path)
    lines = files.with_line_numbers(spark, path)
    return lines.select(F.col("line_no").alias("place"), F.from_json("value", "condition string, seed string, f0 double, f1 double, f2 double, f3 double, f4 double").alias("r")).select("place", "r.*")


@query(f"with c as (select {_TOTALS} from ({_JOINT})) select *, {_prf()} from c")
def metrics_document(spark, d):
    """A run's metrics written as one JSON document and read back."""
    path = files.scratch(spark, "metrics")
    files.write_document(score_micro_total(spark, d), path)
    return files.read_json_document(spark, path, "tp bigint, fp bigint, fn bigint, precision double, recall double, f1 double")


_FILES = "select concat('/x/', lpad(cast(item_id % 20 as varchar(4)), 2, '0'), '_', lpad(cast(item_id as varchar(9)), 6, '0'), '.txt') as path, text from {benchmark}"


@query(f"with a as (select substr(path, 4, 2) as prefix, row_number() over (partition by substr(path, 4, 2) order by path) as pos, text from ({_FILES})), b as (select substr(path, 4, 2) as prefix, row_number() over (partition by substr(path, 4, 2) order by path) as pos, reverse(text) as text from ({_FILES})) select a.prefix, cast(a.pos as int) as pos, a.text as input, b.text as output from a join b on a.prefix = b.prefix and a.pos = b.pos")
def icl_pairing(spark, d):
    files = fx.spark_sql(spark, d, _FILES)
    return align.pair_files(files, files.select("path", F.reverse("text").alias("text")))


@query()
def icl_sample(spark, d):
    pool = [r["text"] for r in _table(spark, d, "benchmark").orderBy("item_id").collect()]  # the example pool
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return generation.with_examples(docs, pool)


# ---- logs -------------------------------------------------------------------------------------
@query(f"select role, count(*) as docs, count_if(not final_channel_found) as final_channel_missing, count_if(pred_annotation = '[]') as empty_prediction, count_if(hit_max_new_tokens) as hit_max_new_tokens, round(avg(n_gen_tokens), 6) as gen_tokens_mean, cast(max(n_gen_tokens) as int) as gen_tokens_max, round(avg(gen_seconds), 6) as sec_per_doc_mean, round(quantile_cont(gen_seconds, 0.5), 6) as sec_per_doc_median, min(gen_seconds) as sec_per_doc_min, max(gen_seconds) as sec_per_doc_max, round(sum(n_gen_tokens) / sum(gen_seconds), 6) as tok_per_sec from ({fx.RUN_LOG}) group by role")
def ops_metrics(spark, d):
    return analytics.operations(fx.spark_sql(spark, d, fx.RUN_LOG), ["role"])


@query(f"select role, max(x) as upper_median from (select role, gen_seconds as x, row_number() over (partition by role order by gen_seconds) - 1 as r, count(*) over (partition by role) as n from ({fx.RUN_LOG})) where r = n // 2 group by role")
def upper_median(spark, d):
    return fx.spark_sql(spark, d, fx.RUN_LOG).groupBy("role").agg(analytics.upper_median("gen_seconds").alias("upper_median"))


@query(f"select step, arg_max(train_loss, ord) filter (where train_loss is not null) as train_loss, arg_max(val_loss, ord) filter (where val_loss is not null) as val_loss from ({fx.TRAIN_LOG}) group by step")
def loss_history(spark, d):
    return analytics.loss_history(fx.spark_sql(spark, d, fx.TRAIN_LOG), ["train_loss", "val_loss"])


_POINTS = f"select 'run' || cast(step % 3 as varchar(2)) as run, step, min(val_loss) as val_loss from ({fx.TRAIN_LOG}) group by 1, 2"


@query(f"with r as (select run, step, val_loss, case when val_loss is not null then row_number() over (partition by run order by val_loss nulls last, step desc) end as best, row_number() over (partition by run order by step desc) as late from ({_POINTS})), c as (select *, case when best <= 3 then 1 when late <= 2 then 2 when best is not null then 3 else 4 end as class from r), o as (select *, row_number() over (partition by run order by class, case when class in (1, 3) then best when class = 2 then -late else late end) as o from c) select run, step, cast(class as int) as class, cast(o as int) as \"order\" from o where o <= 5")
def checkpoint_retention(spark, d):
    return analytics.retained_checkpoints(fx.spark_sql(spark, d, _POINTS), 3, 2)


@query(f"select count_if(val_loss is not null and isfinite(val_loss)) as finite, count(*) as n from ({fx.TRAIN_LOG})")
def finite_losses(spark, d):
    return fx.spark_sql(spark, d, fx.TRAIN_LOG).agg(F.count_if(tx.finite(F.col("val_loss"))).alias("finite"), F.count(F.lit(1)).alias("n"))


# ---- splits -----------------------------------------------------------------------------------
def _ranked_docs(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", "lang")
    return align.with_rank(docs, "doc_id"), docs.count()


@query()
def holdout_split(spark, d):
    docs, n = _ranked_docs(spark, d)
    return splits.assigned(docs, splits.holdout(n, 0.1, 0.2, 42))


@query()
def kfold_split(spark, d):
    docs, n = _ranked_docs(spark, d)
    return splits.assigned(docs, splits.kfold(n, 5, 2, 42))


@query()
def cv_train_val_test(spark, d):
    docs, n = _ranked_docs(spark, d)
    return splits.assigned(docs, splits.cross_validation(n, 5, 1, 42, 20))


@query()
def cv_shrunk_validation(spark, d):
    docs, n = _ranked_docs(spark, d)
    return splits.assigned(docs, splits.shrunk_validation(n, 5, 1, 42, val_size=7))


_N = "(select count(*) as n from {documents})"


@query(f"with t as (select n, least(greatest(1, cast(round_even(n * 0.2, 0) as bigint)), n - 2) as test from {_N}), v as (select n, test, least(greatest(1, cast(round_even(n * 0.1, 0) as bigint)), n - 1 - test) as val from t) select 'test' as split, test as n from v union all select 'validation', val from v union all select 'train', n - test - val from v")
def holdout_sizes(spark, d):
    return splits.split_sizes(holdout_split(spark, d))


@query(f"with f as (select n, n // 5 + case when n % 5 > 2 then 1 else 0 end as val from {_N}) select 'validation' as split, val as n from f union all select 'train', n - val from f")
def kfold_sizes(spark, d):
    return splits.split_sizes(kfold_split(spark, d))


@query(f"with f as (select n, n // 5 + case when n % 5 > 1 then 1 else 0 end as test from {_N}) select 'test' as split, test as n from f union all select 'validation', least(20, n - test - 1) from f union all select 'train', n - test - least(20, n - test - 1) from f")
def cv_sizes(spark, d):
    return splits.split_sizes(cv_train_val_test(spark, d))


@query(f"select 'validation' as split, cast(7 as bigint) as n union all select 'train', n - 7 from {_N}")
def cv_shrunk_sizes(spark, d):
    return splits.split_sizes(cv_shrunk_validation(spark, d))


@query("select doc_id, cast(1 as bigint) as folds, cast(4 as bigint) as trained from {documents}")
def kfold_cover(spark, d):
    """Over all folds each document validates once and trains in all others."""
    docs, n = _ranked_docs(spark, d)
    each = None
    for fold in range(5):
        part = splits.assigned(docs, splits.kfold(n, 5, fold, 42)).select("doc_id", "split")
        each = part if each is None else each.unionByName(part)
    return each.groupBy("doc_id").agg(F.count_if(F.col("split") == "validation").alias("folds"), F.count_if(F.col("split") == "train").alias("trained"))


@query("select (rank % 5) as fold, count(*) as n from (select row_number() over (order by doc_id) - 1 as rank from {documents}) group by 1")
def given_folds_sizes(spark, d):
    docs, n = _ranked_docs(spark, d)
    told, sizes = np.arange(n) % 5, None
    for fold in range(5):
        part = splits.assigned(docs, splits.given_folds(told, fold, 10, 42)).filter("split = 'test'").agg(F.count(F.lit(1)).alias("n")).select(F.lit(fold).cast("bigint").alias("fold"), "n")
        sizes = part if sizes is None else sizes.unionByName(part)
    return sizes


@query()
def multilabel_folds(spark, d):
    matrix = cleaning.presence_matrix(_label_keys(spark, d), [f"K{i}" for i in range(8)]).orderBy("id").toPandas()  # the labelled study set
    folds = splits.multilabel_folds(matrix.drop(columns="id").to_numpy(), 5, 42)
    return spark.createDataFrame([(int(i), int(f)) for i, f in zip(matrix["id"], folds, strict=True)], "id bigint, fold int")


def _label_keys(spark, d):
    return _table(spark, d, "orders").select((F.col("o_orderkey") % 96).alias("id"), F.concat(F.lit("K"), (F.col("o_custkey") % 8).cast("string")).alias("key")).distinct()


@query()
def epoch_mix(spark, d):
    """Documents as base rows, with half as many benchmark texts again in each epoch."""
    base, n = _ranked_docs(spark, d)
    pool = align.with_rank(_table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("pool").alias("lang")), "doc_id")
    size = pool.count()
    epochs = splits.epoch_mixture(n, size, splits.mixture_target(n, size, 1, 2), 3, 42)
    return splits.mixed(base.withColumn("lang", F.lit("base")), pool, epochs, n).select("epoch", "pos", "doc_id", F.col("lang").alias("origin"))


_MIXED = "with n as (select count(*) as n from {documents}), p as (select count(*) as p from {benchmark}), s as (select n, least(cast(round_even(n / 2.0, 0) as bigint), p) as take from n, p)"


@query(f"{_MIXED} select cast(e as int) as epoch, n as base, n as distinct_base, take as pool, take as distinct_pool, n + take as positions from s, (select unnest(range(1, 4)) as e)")
def epoch_mix_sizes(spark, d):
    own = lambda o, c: F.when(F.col("origin") == o, F.col(c))
    return epoch_mix(spark, d).groupBy("epoch").agg(F.count(own("base", "doc_id")).alias("base"), F.count_distinct(own("base", "doc_id")).alias("distinct_base"), F.count(own("pool", "doc_id")).alias("pool"), F.count_distinct(own("pool", "doc_id")).alias("distinct_pool"), F.count_distinct("pos").alias("positions"))


# ---- files ------------------------------------------------------------------------------------
@query("select doc_id, text, lang from {documents}")
def jsonl_roundtrip(spark, d):
    path = files.scratch(spark, "jsonl")
    files.write_jsonl(_table(spark, d, "documents").select("doc_id", "text", "lang"), path)
    return files.read_jsonl(spark, path, "doc_id long, text string, lang string")


@query("select n_nationkey, n_name, case when n_regionkey = 0 then '' else cast(n_regionkey as varchar) end as region from {nation}")
def tsv_roundtrip(spark, d):
    path = files.scratch(spark, "tsv")
    region = F.when(F.col("n_regionkey") == 0, "").otherwise(F.col("n_regionkey").cast("string"))
    files.write_tsv(_table(spark, d, "nation").select("n_nationkey", "n_name", region.alias("region")), path)
    return files.read_tsv(spark, path, "n_nationkey int, n_name string, region string", ("region",))


@query(f"select cast(ord as bigint) as ord, cast(step as bigint) as step, train_loss, val_loss from ({fx.TRAIN_LOG})")
def csv_losses(spark, d):
    path = files.scratch(spark, "losses")
    fx.spark_sql(spark, d, fx.TRAIN_LOG).select("ord", "step", "train_loss", "val_loss").write.option("header", True).csv(path)
    return files.read_csv(spark, path, "ord bigint, step bigint, train_loss double, val_loss double")


@query("select distinct doc_id from {labels}")
def strict_done_ids(spark, d):
    path = files.scratch(spark, "done")
    files.write_jsonl(_table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id"), "quality"), path)
    return files.read_done_ids(spark, path, strict=True).select(F.col("id").cast("bigint").alias("doc_id"))


@query(f"select cast(seed as int) as seed, cast(fold as int) as fold, cast(count(*) as bigint) as n, cast(sum(tp) as bigint) as tp from ({fx.DOC_KEYS}) group by 1, 2")
def partition_discovery(spark, d):
    path = files.scratch(spark, "runs")
    _doc_keys(spark, d).write.partitionBy("seed", "fold").json(path)
    rows = files.read_partitions(spark, path, "seed=*/fold=*", schema="doc_id string, key string, tp bigint")
    return rows.groupBy(F.col("seed").cast("int").alias("seed"), F.col("fold").cast("int").alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.sum("tp").alias("tp"))


@query("select doc_id as id from {documents} where doc_id not in (select doc_id from {labels})")
def append_and_resume(spark, d):
    """Ids still to do after the labelled ones were appended in two commits."""
    path, docs = files.scratch(spark, "done"), _table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"))
    done = _table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id"), "quality")
    for quality in (0, 1):
        files.write_jsonl(done.filter(F.col("quality") == quality), path, "append")
    return align.unmatched(docs, files.read_done_ids(spark, path)).select(F.col("id").cast("bigint").alias("id"))


# ---- generation -------------------------------------------------------------------------------
@query("select cast(doc_id as varchar) as id, '[{{\"Stage\": \"' || substr(md5('### Note:' || chr(10) || text || chr(10) || '### Events:'), 1, 4) || '\"}}]' as pred_annotation, true as final_channel_found from {documents} where text is not null")
def generate_stub(spark, d):
    docs = _table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    made = generation.job(docs, None, SYSTEM, TEMPLATE)
    return generation.predictions(made).select("id", "pred_annotation", "final_channel_found")


@query("select cast(l_orderkey as varchar(20)) as id, cast(count(*) as bigint) as n from {lineitem} group by 1")
def events_roundtrip(spark, d):
    """Event lists written as JSON again and parsed once more."""
    first = _annotations(spark, d).select(F.col("doc_id").cast("string").alias("id"), lj.events_json(lj.parse_events(F.col("annotation"))["events"]).alias("t"))
    return first.select("id", F.size(lj.parse_events(F.col("t"))["events"]).cast("bigint").alias("n"))

