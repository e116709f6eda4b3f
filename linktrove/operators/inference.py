"""Prompt table and batch inference with a user-supplied model function."""

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linktrove import fixed_values as V
from linktrove.functions.text import page_prompt_text, transcript_prompt_text
from linktrove.functions.urls import strip
from linktrove.sources.batches import small_batches
from linktrove.sources.scratch import materialize

# Own short default instructions; pass other templates to ``build_prompt``.
TEMPLATES = {
    "webpage": "Summarise the page below in about 200 words, then give up to three quotes.",
    "pdf": "Summarise the document below in about 200 words, then give up to three quotes.",
    "github": "Summarise what the code repository below does and who it is for.",
    "youtube": "Summarise the transcript below in about 500 words.",
}

#: Own instruction for joining the answers about the parts of a long text.
JOIN_TEMPLATE = "Below are summaries of consecutive parts of one text. Write one summary of the whole."
CHUNK_CHARS, OVERLAP_CHARS, FAN_IN = 14_000, 400, 8


def build_prompt(texts: DataFrame, templates: dict[str, str] | None = None, kind: str = "kind", text: str = "text") -> DataFrame:
    """Adds ``prompt``: template, header and the text cut to its limit; NULL for other kinds.

    One prompt a text, so a longer text is cut; :func:`summarize_tree` asks about whole texts.
    """
    templates = templates or TEMPLATES
    body = F.when(F.col(kind) == "youtube", transcript_prompt_text(F.col(text))).when(
        F.col(kind) == "github", F.col(text)
    ).otherwise(page_prompt_text(F.col(text)))
    head = F.lit(None).cast("string")
    for name, template in templates.items():
        head = F.when(F.col(kind) == name, F.concat(strip(F.lit(template)), F.lit(V.PROMPT_HEADERS[name]))).otherwise(head)
    return texts.withColumn("prompt", F.concat(head, body))


def unasked(kind: Column, text: Column) -> Column:
    """Answer for texts no model is asked about: empty ones and extraction errors; NULL for others."""
    empty = F.when(kind == "youtube", V.NO_TRANSCRIPT_ANSWER).otherwise(V.NO_TEXT_ANSWER)
    return F.when(F.coalesce(text, F.lit("")) == "", empty).when(text.startswith(V.EXTRACT_ERROR_PREFIX), text)


def chunk_prompts(
    texts: DataFrame, key: str = "doc_id", templates: dict[str, str] | None = None, kind: str = "kind", text: str = "text",
    chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """(key, kind, part, n_parts, prompt, answer): numbered overlapping chunks that cover whole texts.

    ``answer`` is set, and ``prompt`` NULL, where no model is asked.  Other kinds
    than those of the templates have no rows.
    """
    templates = templates or TEMPLATES
    known, whole, step = F.col(kind), F.coalesce(F.col(text), F.lit("")), chunk_chars - overlap
    n = F.greatest(F.ceil((F.length(whole) - overlap) / F.lit(step)).cast("int"), F.lit(1))
    given = unasked(known, whole)
    n = F.when(given.isNotNull(), 1).otherwise(n)
    chunks = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(whole, i * step + 1, F.lit(chunk_chars)))
    head = F.lit(None).cast("struct<template:string,header:string>")
    for name, template in templates.items():
        head = F.when(known == name, F.struct(strip(F.lit(template)).alias("template"), F.lit(V.PROMPT_HEADERS[name]).alias("header"))).otherwise(head)
    rows = texts.where(known.isin(*templates)).select(
        F.col(key), known.alias("kind"), n.alias("n_parts"), head.alias("head"), given.alias("answer"), F.posexplode(chunks).alias("part", "chunk"))
    place = F.when(F.col("n_parts") > 1, F.concat(F.lit(" (Part "), (F.col("part") + 1).cast("string"), F.lit(" of "), F.col("n_parts").cast("string"), F.lit(")")))
    prompt = F.concat("head.template", F.coalesce(place, F.lit("")), "head.header", "chunk")
    return rows.select(key, "kind", "part", "n_parts", F.when(F.col("answer").isNull(), prompt).alias("prompt"), "answer")


def summarize_tree(
    texts: DataFrame, make_fn: Callable[[], Callable[[list[str]], list[str]]], key: str = "doc_id",
    templates: dict[str, str] | None = None, kind: str = "kind", text: str = "text",
    chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, fan_in: int = FAN_IN, max_attempts: int = 3,
) -> DataFrame:
    """(key, kind, summary): the model's answer about whole texts.

    The chunks of a text are answered apart; then ``fan_in`` consecutive answers at
    a time are joined by a further prompt, level by level, until one is left: log of
    the longest text's chunks levels, each a stored table.  A group that holds an
    error answer has the first one as its answer.  ``key`` is unique.
    """
    columns = [key, "kind", "part", "n_parts", "answer"]
    prompts = chunk_prompts(texts, key, templates, kind, text, chunk_chars, overlap)
    done: DataFrame | None = None
    while True:
        asked = summarize_with(prompts, make_fn, max_attempts, out="said")
        level = materialize(asked.withColumn("answer", F.coalesce("answer", "said")).select(*columns), "answers")
        single = level.where("n_parts = 1").select(key, "kind", F.col("answer").alias("summary"))
        done = single if done is None else done.unionByName(single)
        rest = level.where("n_parts > 1")
        if rest.isEmpty():
            return done
        # groups of fan_in answers: bounded lists
        listed = F.sort_array(F.collect_list(F.struct("part", "answer")))
        groups = rest.groupBy(key, "kind", F.floor(F.col("part") / fan_in).cast("int").alias("at"), F.ceil(F.col("n_parts") / fan_in).cast("int").alias("n")).agg(
            listed.alias("said"), F.min(F.when(F.col("answer").startswith(V.SUMMARY_ERROR_PREFIX), F.struct("part", "answer")))["answer"].alias("error"))
        lines = F.array_join(F.transform("said", lambda r: F.concat(F.lit("\n\nPart "), (r["part"] + 1).cast("string"), F.lit(":\n"), r["answer"])), "")
        # a lone answer at the end of a level is passed on
        alone = F.when(F.size("said") == 1, F.col("said")[0]["answer"])
        answer = F.coalesce("error", alone)
        prompts = groups.select(key, "kind", F.col("at").alias("part"), F.col("n").alias("n_parts"),
                                F.when(answer.isNull(), F.concat(F.lit(JOIN_TEMPLATE), lines)).alias("prompt"), answer.alias("answer"))


def summarize_with(
    prompts: DataFrame, make_fn: Callable[[], Callable[[list[str]], list[str]]], max_attempts: int = 3,
    prompt: str = "prompt", out: str = "summary", batch_chars: int = 1_000_000,
) -> DataFrame:
    """Adds the model's answer for each prompt.

    ``make_fn`` is called once per partition and returns ``list[str] ->
    list[str]``.  A failing batch is tried again, then row by row; what still
    fails gets the error text as its answer.  Rows without prompt get NULL.
    A call gets prompts of up to ``batch_chars`` characters together, a longer
    prompt alone.  A worker holds small Arrow batches and the strings of
    one call.
    """
    names = prompts.columns
    asked, place = names.index(prompt), names.index(out) if out in names else len(names)
    prefix = V.SUMMARY_ERROR_PREFIX  # a plain value, so that tasks need not import this package
    schema = prompts.withColumn(out, F.lit(None).cast("string")).schema

    def call(fn, batch: list[str]) -> list[str]:
        error: Exception | None = None
        for _ in range(max_attempts):
            try:
                answers = fn(batch)
                if len(answers) != len(batch):
                    raise ValueError(f"{len(answers)} answers for {len(batch)} prompts")
                return answers
            except Exception as e:  # noqa: BLE001 - any model failure becomes row text
                error = e
        if len(batch) == 1:
            return [f"{prefix} {error}"]
        return [call(fn, [one])[0] for one in batch]

    def calls(lengths: list[int | None]) -> Iterator[tuple[int, int]]:
        at, chars, some = 0, 0, False
        for k, n in enumerate(lengths):
            if n is not None:
                if some and chars + n > batch_chars:
                    yield at, k
                    at, chars = k, 0
                chars, some = chars + n, True
        yield at, len(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = None
        for batch in batches:
            for at, end in calls(pc.utf8_length(batch.column(asked)).to_pylist()):
                rows = batch.slice(at, end - at)
                texts = rows.column(asked).to_pylist()
                todo = [t for t in texts if t is not None]
                if todo:
                    fn = fn or make_fn()
                    said = iter(call(fn, todo))
                    texts = [None if t is None else next(said) for t in texts]
                answers = pa.array(texts, pa.string(), from_pandas=True)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[:place], answers, *rows.columns[place + 1:]], names=[*names[:place], out, *names[place + 1:]])

    small_batches(prompts.sparkSession)
    return prompts.mapInArrow(run, schema)
