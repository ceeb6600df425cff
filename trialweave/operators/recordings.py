"""Recorded completions: a strict reader of recordings, and their replay against the requests that a run sends.

A recording is a JSON file of completions in order, some with the messages they expect. Request k of a run gets completion
k; if that names messages, the request's have to be equal, or the first difference is said: where a role, a content (and
its first differing character) or the number of messages departs, without quoting any content.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The keys of a recording, of a completion and of a message.
TOP, ENTRY, MESSAGE = {"synthetic", "completions"}, {"text", "messages"}, {"role", "content"}
MESSAGES = "array<struct<role:string,content:string>>"
RECORDINGS = f"recording string, call long, text string, messages {MESSAGES}, problem string"


class BadRecording(ValueError):
    pass


def completions(raw: bytes) -> list[tuple[str, list[dict] | None]]:
    """(text, messages or None) of each completion; a BadRecording says what is wrong."""

    def must(ok: bool, what: str) -> None:
        if not ok:
            raise BadRecording(what)

    must(raw.isascii(), "not plain ASCII")
    try:
        data = json.loads(raw)
    except json.JSONDecodeError as e:
        raise BadRecording(f"not valid JSON: {e.msg} at line {e.lineno}") from None
    must(isinstance(data, dict) and set(data) == TOP, "not an object with exactly the keys synthetic and completions")
    must(data["synthetic"] is True, "not labelled as synthetic")
    must(isinstance(data["completions"], list), "completions is no list")
    out = []
    for k, e in enumerate(data["completions"], 1):
        must(isinstance(e, dict) and set(e) <= ENTRY, f"completion {k} has other keys than text and messages")
        must(isinstance(e.get("text"), str), f"completion {k} has no text")
        asked = e.get("messages")
        must("messages" not in e or isinstance(asked, list), f"completion {k}: messages is no list")
        for i, m in enumerate(asked or [], 1):
            must(isinstance(m, dict) and set(m) == MESSAGE, f"completion {k}, message {i} has not exactly the keys role and content")
            must(all(isinstance(v, str) for v in m.values()), f"completion {k}, message {i}: role and content must be strings")
        out.append((e["text"], asked))
    return out


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """(recording, call from 1, text, messages, problem): a row for each completion, or one with the file's problem."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            rows = []
            for name, raw in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                try:
                    rows += [(name, k, text, asked, None) for k, (text, asked) in enumerate(completions(raw), 1)]
                except BadRecording as e:
                    rows.append((name, None, None, None, str(e)))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.list_(pa.struct([("role", pa.string()), ("content", pa.string())])), pa.string())
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["recording", "call", "text", "messages", "problem"])

    return files.mapInArrow(run, RECORDINGS)


def common_prefix(a: Column, b: Column) -> Column:
    """How many characters two texts have in common from their beginning, by halving: 31 comparisons of prefixes, no loop over characters."""
    most = F.least(F.length(a), F.length(b))
    step = lambda n, power: F.when((n + power <= most) & (F.substring(a, F.lit(1), n + power) == F.substring(b, F.lit(1), n + power)), n + power).otherwise(n)
    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), F.lit(0), step)


def first_difference(expected: Column, sent: Column) -> Column:
    """(message, kind, place): the first message that differs, by role, content (place: the first differing character) or count; null if none does."""
    both = F.least(F.size(expected), F.size(sent))
    at = F.array_position(F.transform(F.slice(expected, F.lit(1), both), lambda m, i: ~m.eqNullSafe(F.get(sent, i))), True).cast("int")
    want, got = F.try_element_at(expected, at), F.try_element_at(sent, at)
    row = lambda n, kind, place: F.struct(n.cast("long").alias("message"), F.lit(kind).alias("kind"), place.cast("long").alias("place"))
    by_role = ~want["role"].eqNullSafe(got["role"])
    none = F.lit(None)
    return F.when(at > 0, F.when(by_role, row(at, "role", none)).otherwise(row(at, "content", common_prefix(want["content"], got["content"])))).when(F.size(expected) != F.size(sent), row(both + 1, "count", none))


def said(expected: Column, sent: Column, d: Column) -> Column:
    """A first difference in words."""
    want, got = F.try_element_at(expected, d["message"].cast("int")), F.try_element_at(sent, d["message"].cast("int"))
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    by_role = text("message ", d["message"], " has role ", quoted(got["role"]), ", expected ", quoted(want["role"]))
    by_content = text("message ", d["message"], " (", want["role"], ") differs at character ", d["place"], " (length ", F.length(got["content"]), ", expected ", F.length(want["content"]), ")")
    by_count = text(F.size(sent), " message(s) sent, ", F.size(expected), " expected")
    return F.when(d["kind"] == "role", by_role).when(d["kind"] == "content", by_content).when(d["kind"] == "count", by_count)


def words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != ""))


def replayed(requests: DataFrame, recordings: DataFrame, keys: list[str]) -> DataFrame:
    """``requests`` (keys, recording, call from 1, messages) with what the recording answers.

    Columns: text, prompt_tokens and completion_tokens (words, as an approximation), and a problem: the recording is bad, is
    used up, or expects other messages. A run ends with its first problem: what it asks after that has no answer either.
    """
    from pyspark.sql import Window

    r = recordings.select(F.col("recording").alias("__r"), F.col("call").alias("__c"), "text", F.col("messages").alias("expected"), F.col("problem").alias("bad"))
    good, bad = r.where("bad is null").drop("bad"), r.where("bad is not null").select(F.col("__r").alias("__b"), "bad")
    j = requests.join(bad, F.col("recording") == F.col("__b"), "left").join(good, (F.col("recording") == F.col("__r")) & (F.col("call") == F.col("__c")), "left")
    sent = F.transform("messages", lambda m: F.struct(F.coalesce(m["role"], F.lit("")).alias("role"), F.coalesce(m["content"], F.lit("")).alias("content")))
    j = j.withColumn("sent", sent).withColumn("d", F.when(F.col("expected").isNotNull(), first_difference(F.col("expected"), F.col("sent"))))
    problem = F.when(F.col("bad").isNotNull(), F.concat(F.lit("bad recording: "), "bad")).when(F.col("text").isNull(), "the recording is used up").otherwise(said(F.col("expected"), F.col("sent"), F.col("d")))
    j = j.withColumn("problem", problem)
    ended = F.max(F.col("problem").isNotNull()).over(Window.partitionBy(*keys).orderBy("call").rowsBetween(Window.unboundedPreceding, -1))
    j = j.withColumn("problem", F.when(F.coalesce(ended, F.lit(False)), "the run has ended").otherwise(F.col("problem")))
    ok = F.col("problem").isNull()
    prompt = F.aggregate("sent", F.lit(0), lambda n, m: n + words(m["content"]))
    return j.select(*keys, "recording", "call", F.when(ok, F.col("text")).alias("text"), F.when(ok, prompt.cast("long")).alias("prompt_tokens"), F.when(ok, words(F.col("text")).cast("long")).alias("completion_tokens"), "problem")
