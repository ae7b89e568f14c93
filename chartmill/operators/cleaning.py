"""Cleaning of event lists: native array transforms over parsed events, and their counters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lenient_json as lj
from ..functions.text import SPACE, bound, split_value_tokens, trim_u

# Phrases that name a site, by side, and the sites of bronchial segments.
SITE_PHRASES = {
    "右": [("右肺上葉|右上葉", "右肺上葉"), ("右肺中葉|右中葉", "右肺中葉"), ("右肺下葉|右下葉", "右肺下葉"), ("右肺門部|右肺門|#10R", "右肺門部")],
    "左": [("左肺上葉|左上葉", "左肺上葉"), ("左肺下葉|左下葉", "左肺下葉"), ("左肺門部|左肺門|#10L", "左肺門部")],
}
SEGMENTS = {
    "右": {"右肺上葉": ["1", "2", "3"], "右肺中葉": ["4", "5"], "右肺下葉": ["6", "7", "8", "9", "10"]},
    "左": {"左肺上葉": ["1", "1+2", "2", "3", "4", "5"], "左肺下葉": ["6", "7", "8", "9", "10"]},
}
ANY_SITE = "肺"
#: What makes a candidate more or less than one token, or its JSON more than the text in quotes; an empty one is no token.
SEPARATED = re.compile(rf'^{SPACE}|{SPACE}\Z|[,、，"\\\x00-\x1f]|^\Z')


def infer_site(text: Column, side: str) -> Column:
    """The one site of a side that a note points at by phrase or segment, else null."""
    named = [F.when(F.coalesce(text, F.lit("")).rlike(p), F.lit(site)) for p, site in SITE_PHRASES[side]]
    of = F.create_map(*(F.lit(x) for site, segments in SEGMENTS[side].items() for s in segments for x in (s, site)))
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"{side}S\s*(1\+2|[1-9]|10)"), F.lit(1)), lambda s: of[s])
    sites = F.array_distinct(F.filter(F.concat(F.array(*named), found), lambda s: s.isNotNull()))
    return F.when(F.size(sites) == 1, F.try_element_at(sites, F.lit(1)))


def _rebuild(event: Column, entries: Column) -> Column:
    """An event with other entries; its signature is told anew from keys in order."""

    def built(held: Column) -> Column:
        pairs = F.sort_array(F.transform(held, lambda e: F.concat(e["name"], F.lit(":"), e["json"])))
        return F.struct(event["ord"].alias("ord"), F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")).alias("sig"), held.alias("entries"))

    return bound(entries, built)


def _text_entry(entry: Column, text: Column) -> Column:
    def built(told: Column) -> Column:
        quoted = F.concat(F.lit('"'), F.replace(F.replace(told, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
        return F.struct(entry["key"].alias("key"), entry["name"].alias("name"), F.lit(None).cast("string").alias("tenth"), F.lit("str").alias("jtype"), told.alias("raw"), F.lit(None).cast("array<string>").alias("items"), quoted.alias("json"))

    return bound(text, built)


def _nonempty(events: Column) -> Column:
    return F.filter(events, lambda ev: F.size(ev["entries"]) > 0)


def drop_unknown_keys(events: Column, allowed: list[str]) -> Column:
    """Entries with a known key; events left without any go."""
    known = lambda e: e["key"].isin(*allowed)
    return _nonempty(F.transform(events, lambda ev: F.when(F.forall(ev["entries"], known), ev).otherwise(_rebuild(ev, F.filter(ev["entries"], known)))))


def normalize_sites(events: Column, note: Column) -> Column:
    """A textual Site that names only a side gets the site the note points at, or the whole organ."""
    right, left = (F.coalesce(infer_site(note, s), F.lit(ANY_SITE)) for s in ("右", "左"))

    def tokens(e: Column) -> Column:
        return F.filter(F.transform(F.split(e["raw"], ","), trim_u), lambda t: t != "")

    def is_touched(e: Column) -> Column:
        return (e["key"] == "Site") & (e["jtype"] == "str") & F.coalesce(F.exists(tokens(e), lambda t: t.isin("右肺", "左肺")), F.lit(False))

    def entry(e: Column) -> Column:
        told = F.array_join(F.array_distinct(F.transform(tokens(e), lambda t: F.when(t == "右肺", right).when(t == "左肺", left).otherwise(t))), ", ")
        return F.when(is_touched(e), _text_entry(e, told)).otherwise(e)

    return F.transform(events, lambda ev: F.when(F.exists(ev["entries"], is_touched), _rebuild(ev, F.transform(ev["entries"], entry))).otherwise(ev))


def value_tokens(entry: Column) -> Column:
    """Tokens of an entry's value; a list gives those of its elements, null none."""
    listed = F.flatten(F.transform(entry["items"], split_value_tokens))
    return F.when(entry["jtype"] == "null", F.array().cast("array<string>")).when(entry["jtype"] == "list", listed).otherwise(split_value_tokens(entry["raw"]))


def _candidates(allowed: dict[str, list[str]]) -> Column:
    return F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*(F.lit(v) for v in x)) for item in allowed.items() if item[1] for x in item))


def keep_candidates(entry: Column, allowed: dict[str, list[str]]) -> Column:
    """Distinct tokens of an entry among its key's candidates, in order; null without a candidate list."""
    return F.when(_candidates(allowed)[entry["key"]].isNotNull(), F.array_intersect(F.array_distinct(value_tokens(entry)), _candidates(allowed)[entry["key"]]))


def drop_other_values(events: Column, allowed: dict[str, list[str]]) -> Column:
    """Values outside their key's candidates go; then keys without values and events without keys."""
    limited = lambda e: e["key"].isin(*[k for k, v in allowed.items() if v])
    plain = {k: told for k, v in allowed.items() if (told := [x for x in v if not SEPARATED.search(x)])}

    def is_touched(e: Column) -> Column:
        """Whether an entry is limited and its value is not one candidate as it is, of which nothing changes."""
        if not plain:
            return limited(e)
        stays = (e["jtype"] == "str") & e["tenth"].isNull() & F.coalesce(F.array_contains(_candidates(plain)[e["key"]], e["raw"]), F.lit(False))
        return limited(e) & ~stays

    def entries(ev: Column) -> Column:
        told = F.transform(ev["entries"], lambda e: F.when(is_touched(e), _text_entry(e, F.array_join(keep_candidates(e, allowed), ", "))).otherwise(e))
        return F.filter(told, lambda e: ~(limited(e) & (e["raw"] == "")))

    # Events with a limited key all get a new signature, touched or not: those that are equal now must have the same.
    return _nonempty(F.transform(events, lambda ev: F.when(F.exists(ev["entries"], limited), _rebuild(ev, entries(ev))).otherwise(ev)))


def drop_timestamp_only(events: Column) -> Column:
    return F.filter(events, lambda ev: ~((F.size(ev["entries"]) == 1) & (ev["entries"][0]["key"] == "Timestamp")))


def dedupe(events: Column) -> Column:
    """The first of the events with one signature; no event is copied before it is known to stay."""
    first = lambda sigs: lambda ev, i: ev["sig"].isNull() | (F.array_position(sigs, ev["sig"]) == i + 1)
    return bound(F.transform(events, lambda ev: ev["sig"]), lambda sigs: F.filter(events, first(sigs)))


def clean(notes: DataFrame, annotations: DataFrame, allowed_keys: list[str] | None = None, allowed_values: dict[str, list[str]] | None = None, sites: bool = True, timestamp_only: bool = True, deduplicate: bool = True) -> DataFrame:
    """Every stage's event list for each note with an annotation, in the fixed order of the stages.

    notes (id, progress_note) keep their repeats; annotations (id, annotation) have one row per id.
    status null, failed or scalar is a parse error, whose lists are empty.
    """
    df = notes.join(annotations, "id").withColumn("parsed", lj.parse_events(F.col("annotation")))
    df = df.select("id", "progress_note", F.col("parsed.status").alias("status"), F.col("parsed.events").alias("e0"))
    step = lambda on, f: f if on else (lambda c: c)
    df = df.withColumn("e1", step(allowed_keys is not None, lambda c: drop_unknown_keys(c, allowed_keys or []))(F.col("e0")))
    df = df.withColumn("e2", step(sites, lambda c: normalize_sites(c, F.col("progress_note")))(F.col("e1")))
    df = df.withColumn("e3", step(bool(allowed_values), lambda c: drop_other_values(c, allowed_values or {}))(F.col("e2")))
    df = df.withColumn("e4", step(timestamp_only, drop_timestamp_only)(F.col("e3")))
    return df.withColumn("e5", step(deduplicate, dedupe)(F.col("e4")))


def cleaned(stages: DataFrame) -> DataFrame:
    """id, progress_note and the cleaned annotation as JSON; rows without events go."""
    # A filter would be pushed through the stages and the join, and all of them computed again for it.
    kept = F.explode(F.filter(F.array("e5"), lambda e: F.size(e) > 0)).alias("e")
    return stages.select("id", "progress_note", kept).select("id", "progress_note", lj.events_json(F.col("e")).alias("annotation"))


def counters(stages: DataFrame, allowed_values: dict[str, list[str]]) -> DataFrame:
    """One row of counts over all stages, in a single pass with map-side sums."""
    ok = F.col("status").isin("ok", "lenient")
    entries = lambda c: F.aggregate(F.transform(c, lambda ev: F.size(ev["entries"])), F.lit(0), lambda a, b: a + b)
    limited = list(allowed_values)
    dropped = F.aggregate(
        F.flatten(F.transform("e2", lambda ev: F.transform(F.filter(ev["entries"], lambda e: e["key"].isin(*limited)), lambda e: F.size(F.filter(value_tokens(e), lambda t: ~F.array_contains(_candidates(allowed_values)[e["key"]], t)))))),
        F.lit(0),
        lambda a, b: a + b,
    )
    return stages.agg(
        F.count(F.lit(1)).alias("annotated"),
        F.count_if(~ok).alias("parse_error"),
        F.count_if(ok & (F.size("e5") == 0)).alias("empty"),
        F.count_if(ok & (F.size("e5") > 0)).alias("clean_rows"),
        F.sum(entries(F.col("e0")) - entries(F.col("e1"))).alias("unknown_keys"),
        F.sum(F.size("e0") - F.size("e1")).alias("events_after_unknown"),
        F.sum(F.when(ok, dropped).otherwise(0)).alias("other_value_tokens"),
        F.sum(entries(F.col("e2")) - entries(F.col("e3"))).alias("keys_after_values"),
        F.sum(F.size("e2") - F.size("e3")).alias("events_after_values"),
        F.sum(F.size("e3") - F.size("e4")).alias("timestamp_only_events"),
        F.sum(F.size("e4") - F.size("e5")).alias("repeated_events"),
    )


def dropped_tokens_by_key(stages: DataFrame, allowed_values: dict[str, list[str]]) -> DataFrame:
    """key, dropped: tokens outside the candidates of each key."""
    each = stages.select(F.explode(F.flatten(F.transform("e2", lambda ev: ev["entries"]))).alias("e")).filter(F.col("e.key").isin(*allowed_values))
    n = F.size(F.filter(value_tokens(F.col("e")), lambda t: ~F.array_contains(_candidates(allowed_values)[F.col("e.key")], t)))
    return each.select(F.col("e.key").alias("key"), n.alias("n")).groupBy("key").agg(F.sum("n").alias("dropped")).filter("dropped > 0")


def keys_present(parsed: DataFrame) -> DataFrame:
    """id, key (of evaluation) for keys with a value that is not null, blank or an empty list."""
    from ..functions.schema import EVAL_KEYS
    from ..functions.text import eval_key

    each = parsed.select("id", F.explode(F.flatten(F.transform("events", lambda ev: ev["entries"]))).alias("e"))
    told = (F.col("e.jtype") != "null") & ~((F.col("e.jtype") == "str") & (trim_u(F.col("e.raw")) == "")) & ~((F.col("e.jtype") == "list") & (F.size("e.items") == 0))
    return each.filter(told).select("id", eval_key(F.col("e.key")).alias("key")).filter(F.col("key").isin(*EVAL_KEYS)).distinct()


def presence_matrix(present: DataFrame, keys: list[str]) -> DataFrame:
    """A 0/1 column per key and a row per id."""
    return present.groupBy("id").pivot("key", keys).agg(F.lit(1)).na.fill(0)
