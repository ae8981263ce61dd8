"""Topic and theme texts from a pluggable text generator, with keyword fallback."""

from __future__ import annotations

import asyncio
import hashlib
import uuid
from collections.abc import Awaitable, Callable

from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions import text
from callweave.functions.fixed import PROMPT_SENTENCES, PROMPT_SUMMARIES, TOPIC_KEYWORDS

Generate = Callable[[str], Awaitable[str]]


class Unavailable(Exception):
    """A failed call; `status` is the HTTP status, None for a timeout or connection loss."""

    def __init__(self, status: int | None = None):
        super().__init__(f"status {status}")
        self.status = status

    @property
    def passing(self) -> bool:
        return self.status is None or self.status == 429 or self.status >= 500


def topic_prompt(keywords: Column, sentences: Column) -> Column:
    return F.concat(
        F.lit("Describe in one or two sentences what these statements from a company call have in common.\nKeywords: "),
        F.array_join(F.slice(keywords, 1, TOPIC_KEYWORDS), ", "),
        F.lit("\nStatements:\n"),
        text.bullets(sentences, PROMPT_SENTENCES),
    )


def theme_prompt(name: Column, keywords: Column, summaries: Column) -> Column:
    return F.concat(
        F.lit("Describe the theme that these topics from several companies share.\nTheme: "), name,
        F.lit("\nKeywords: "), F.array_join(F.slice(keywords, 1, TOPIC_KEYWORDS), ", "),
        F.lit("\nTopics:\n"), text.bullets(summaries, PROMPT_SUMMARIES),
    )


async def _answer(generate: Generate, prompt: str, gate: asyncio.Semaphore, timeout: float, tries: int, wait: float):
    async with gate:
        for attempt in range(tries):
            try:
                return await asyncio.wait_for(generate(prompt), timeout)
            except TimeoutError:
                failure = Unavailable()
            except Unavailable as error:
                failure = error
            except Exception:  # any other fault of a client costs its own answer only
                return None
            if not failure.passing:
                return None
            if attempt + 1 < tries:
                await asyncio.sleep(wait * 2**attempt)
        return None


class AnswerLog:
    """Answers by prompt in a folder that all tasks reach: one file each, written under another name and moved when whole.

    What a task has paid for is there for its retry, for other tasks and for the next run.
    """

    def __init__(self, folder: str):
        self.files, self.folder = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)

    def _path(self, prompt: str) -> str:
        key = hashlib.sha256(prompt.encode()).hexdigest()
        return f"{self.folder}/{key[:2]}/{key}"

    def get(self, prompt: str) -> str | None:
        path = self._path(prompt)
        if self.files.get_file_info(path).type != fs.FileType.File:
            return None
        with self.files.open_input_stream(path) as stream:
            return stream.read().decode()

    def put(self, prompt: str, answer: str) -> None:
        path = self._path(prompt)
        self.files.create_dir(path.rpartition("/")[0])
        part = f"{path}.{uuid.uuid4().hex}"
        with self.files.open_output_stream(part) as stream:
            stream.write(answer.encode())
        self.files.move(part, path)


def generated(
    rows: DataFrame,
    prompt: str,
    factory: Callable[[], Generate],
    out: str,
    concurrent: int = 50,
    timeout: float = 30.0,
    tries: int = 3,
    wait: float = 1.0,
    log: str | None = None,
) -> DataFrame:
    """Answers to the prompt column, NULL where a call fails for good.

    `concurrent` limits the open calls of the whole job: the rows are dealt to at most as many tasks, which share the permits
    evenly. With a `log` folder an answer is kept as it arrives and looked up before a call, so a task that is run again
    pays for no answer twice; failed calls are not kept. Equal prompts are one call.
    """
    schema = rows.withColumn(out, F.lit(None).cast("string")).schema
    slots = max(1, min(concurrent, rows.sparkSession.sparkContext.defaultParallelism))
    permits = max(1, concurrent // slots)

    def run(frames):
        generate = factory()
        kept = AnswerLog(log) if log else None

        async def answered(asked: str, gate: asyncio.Semaphore):
            known = kept.get(asked) if kept else None
            if known is not None:
                return known
            found = await _answer(generate, asked, gate, timeout, tries, wait)
            if kept and found is not None:
                kept.put(asked, found)
            return found

        async def batch(prompts):
            gate = asyncio.Semaphore(permits)
            each = list(dict.fromkeys(p for p in prompts if p is not None))
            return dict(zip(each, await asyncio.gather(*[answered(p, gate) for p in each]), strict=True))

        for frame in frames:
            found = asyncio.run(batch(list(frame[prompt])))
            yield frame.assign(**{out: [found.get(p) for p in frame[prompt]]})

    return rows.repartition(slots, F.col(prompt)).mapInPandas(run, schema)  # equal prompts are one call


def with_fallback(rows: DataFrame, summary: str, representation: str) -> DataFrame:
    """Keyword text where there is no summary."""
    return rows.withColumn(summary, F.coalesce(text.missing_text(F.col(summary)), F.col(representation)))


def entity_rows(extracted: DataFrame, sentence: str = "sentence_id", entities: str = "entities") -> DataFrame:
    """Rows (type, value, confidence) from a map of entity type to found entities."""
    typed = extracted.select(sentence, F.explode(entities).alias("entity_type", "_found"))
    one = typed.select(sentence, "entity_type", F.explode("_found").alias("_e"))
    return one.select(
        sentence, "entity_type", F.col("_e.name").alias("value"), F.col("_e.confidence").alias("confidence")
    )
