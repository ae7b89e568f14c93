"""Row-wise model calls behind a small protocol, in-context examples, and what follows a call."""

from __future__ import annotations

import hashlib
import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lenient_json as lj
from ..functions.text import channel_text, final_channel, render_prompt
from .align import present, unmatched

RESULT = "id string, input string, output string, n_gen_tokens int, gen_seconds double, error string"


class Generator(Protocol):
    """What calls a model: a batch of (system, user) prompts to a batch of texts."""

    def __call__(self, prompts: list[tuple[str, str]]) -> list[str]: ...


def echo(prompts: list[tuple[str, str]]) -> list[str]:
    """An offline stand-in: a fixed event list told by the prompt's MD5."""
    return [f'[{{"Stage": "{hashlib.md5(user.encode()).hexdigest()[:4]}"}}]' for _, user in prompts]


def with_retries(call: Generator, attempts: int = 5, first_wait: float = 1.0, most_wait: float = 30.0, retryable: Callable[[Exception], bool] = lambda e: isinstance(e, (OSError, TimeoutError)), seed: int | None = None) -> Generator:
    """Call again after growing, jittered waits while the error is one that may pass.

    A seed makes the jitter the same for the same prompts.
    """

    def run(prompts: list[tuple[str, str]]) -> list[str]:
        jitter = random.Random() if seed is None else random.Random(f"{seed}{prompts}")
        for i in range(attempts):
            try:
                return call(prompts)
            except Exception as e:
                if i + 1 == attempts or not retryable(e):
                    raise
                time.sleep(min(most_wait, first_wait * 2**i) * (0.5 + jitter.random() / 2))
        raise AssertionError

    return run


def generate(rows: DataFrame, system: str, template: str, call: Generator = echo, context: str | None = None, batch: int = 8) -> DataFrame:
    """RESULT rows for (id, text[, context]); a row whose call fails carries its error instead."""
    prompt = render_prompt(template, F.col("text"), F.col(context) if context else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ids, texts, users = (rows.column(i).to_pylist() for i in range(3))
            out: list[tuple] = []
            for a in range(0, len(ids), batch):
                part, began = [(system, u) for u in users[a : a + batch]], time.time()
                try:
                    got, errors = call(part), [None] * len(part)
                except Exception:  # one bad row must not take its batch along
                    got, errors = [], []
                    for p in part:
                        try:
                            got.append(call([p])[0])
                            errors.append(None)
                        except Exception as e:
                            got.append(None)
                            errors.append(f"{type(e).__name__}: {e}")
                spent = (time.time() - began) / max(1, len(part))
                out += [(i, t, g, None if g is None else len(g.split()), spent, e) for i, t, g, e in zip(ids[a : a + batch], texts[a : a + batch], got, errors, strict=True)]
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["id", "input", "output", "n_gen_tokens", "gen_seconds", "error"])

    return rows.select(F.col("id").cast("string").alias("id"), "text", prompt.alias("prompt")).mapInArrow(run, RESULT)


def job(source: DataFrame, done: DataFrame | None, system: str, template: str, call: Generator = echo, context: str | None = None) -> DataFrame:
    """Rows still to do with a text, generated; see generate."""
    todo = source if done is None else unmatched(source, done)
    return generate(present(todo, ["id", "text"], blank_is_missing=False), system, template, call, context)


def preview(source: DataFrame, done: DataFrame | None, template: str, n: int, context: str | None = None) -> tuple[DataFrame, DataFrame]:
    """What a job would send, without a call: the first n rows by id with their prompts, and one row of
    counts: rows in all, already done, without id or text, and to do."""
    keyed = source.withColumn("_done", F.lit(False)) if done is None else source.join(done.select("id").distinct().withColumn("_done", F.lit(True)), "id", "left")
    finished, whole = F.coalesce("_done", F.lit(False)), F.col("id").isNotNull() & F.col("text").isNotNull()
    counts = keyed.agg(F.count(F.lit(1)).alias("total"), F.count_if(finished).alias("done"), F.count_if(~finished & ~whole).alias("missing"), F.count_if(~finished & whole).alias("todo"))
    rows = keyed.filter(~finished & whole).withColumn("prompt", render_prompt(template, F.col("text"), F.col(context) if context else None))
    return rows.select("id", "prompt").orderBy("id").limit(n), counts


#: The jobs that make a dataset, by name: a template and whether a row comes with a context.
JOBS = {
    "translate": ("Translate the text.\n\n{{INPUT}}", False),
    "summarise": ("Summarise the record.\n\n{{INPUT}}", False),
    "note": ("{{CONTEXT}}\n\nWrite a progress note from the summary.\n\n{{INPUT}}", True),
    "annotate": ("{{CONTEXT}}\n\nList the events of the note as JSON.\n\n{{INPUT}}", True),
}


def named_job(name: str, source: DataFrame, done: DataFrame | None, system: str, call: Generator = echo, template: str | None = None) -> DataFrame:
    """One of JOBS, with its own template or another; those with a context read it from the column `context`."""
    usual, with_context = JOBS[name]
    return job(source, done, system, template or usual, call, "context" if with_context else None)


def predictions(generated: DataFrame, channels: bool = False, most: int = 64, strict: bool = False) -> DataFrame:
    """id, raw and canonical prediction; channel-formatted output is unwrapped first."""
    ok = generated.filter("error is null")
    if not channels:
        return ok.select("id", F.col("output").alias("raw_pred_annotation"), lj.canonicalize_prediction(F.col("output"), most).alias("pred_annotation"), F.lit(True).alias("final_channel_found"))
    return reparse(ok.select("id", F.col("output").alias("raw_pred_annotation")), strict, most)


def reparse(raw: DataFrame, strict: bool = False, most: int = 64) -> DataFrame:
    """Predictions told anew from raw channel-formatted text; strict takes the final channel only."""
    text, found = (final_channel if strict else channel_text)(F.col("raw_pred_annotation"))
    return raw.withColumn("_t", text).withColumn("final_channel_found", found).withColumn("pred_annotation", lj.canonicalize_prediction(F.col("_t"), most)).drop("_t")


def example_context(record_id: str, pool: list, n: int, seed: int) -> list:
    """n distinct pool entries for a record, by CPython's generator seeded with seed XOR its MD5."""
    if len(pool) < n:
        raise ValueError(f"{n} examples asked of {len(pool)}")
    own = seed ^ int(hashlib.md5(record_id.encode()).hexdigest()[:8], 16)
    return random.Random(own).sample(pool, k=n)


def with_examples(rows: DataFrame, pool: list[str], n: int = 3, seed: int = 42, name: str = "context") -> DataFrame:
    """Each row's numbered single-text examples; the pool is a handful of files."""
    pick = F.udf(lambda i: "\n\n".join(f"【例{k}】\n{t}" for k, t in enumerate(example_context(i, pool, n, seed), 1)), "string", useArrow=True)
    return rows.withColumn(name, pick(F.col("id").cast("string")))


def with_paired_examples(rows: DataFrame, pool: list[tuple[str, str]], input_label: str, output_label: str, n: int = 3, seed: int = 42, name: str = "context") -> DataFrame:
    """Each row's numbered input and output examples under their labels."""
    if not input_label or not output_label:
        raise ValueError("both labels are needed")

    def text(i: str) -> str:
        return "\n\n".join(f"【例{k}の{input_label}】\n{a}\n\n【例{k}の{output_label}】\n{b}" for k, (a, b) in enumerate(example_context(i, pool, n, seed), 1))

    return rows.withColumn(name, F.udf(text, "string", useArrow=True)(F.col("id").cast("string")))


def token_lengths(rows: DataFrame, text: str, tokenize: Callable[[str], int] | None = None, most: int | None = None) -> DataFrame:
    """rows with length (of a tokenizer, else of code points), cut at `most` if given."""
    n = F.udf(tokenize, "int", useArrow=True)(text) if tokenize else F.length(text)
    return rows.withColumn("length", F.least(n, F.lit(most)) if most else n)
