"""Batch control: manifests, prompts, answers, remote calls with retry and bisection, resumable sinks."""

from __future__ import annotations

import hashlib
import json
import random
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lumenfold.operators.numbering import numbered


def pair_manifest(pairs: DataFrame, order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """pairs with their index, from 0, in a total order; see numbered."""
    return numbered(pairs, order, "index", partitions)


def batch_manifest(manifest: DataFrame, size: int, member: str) -> DataFrame:
    """Batches of consecutive members: start, size, ordered members and the digest of their JSON list."""
    g = manifest.withColumn("batch_index", F.floor(F.col("index") / size)).groupBy("batch_index")
    b = g.agg(F.min("index").alias("start_index"), F.count("*").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("index", F.col(member).cast("string").alias("m")))), lambda s: s["m"]).alias("members"))
    return b.withColumn("batch_id", F.format_string("batch-%06d", "batch_index")).withColumn("membership_sha256", F.sha2(F.to_json("members"), 256))


def prompts(records: DataFrame, batch: str, order: str, fields: Sequence[str], template: str, slot: str = "{{records}}") -> DataFrame:
    """One prompt per batch: the template with the batch's records as a JSON list in order."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*fields).alias("r")))), lambda s: s["r"])
    return records.groupBy(batch).agg(F.replace(F.lit(template), F.lit(slot), F.to_json(rows, {"ignoreNullFields": "false"})).alias("prompt"))


#: The texts that every result must have; it must also have a whole number as its confidence.
RESPONSE_TEXTS = ("pair_id", "verdict", "relation_type", "directness", "security_objective", "justification", "caveat")
VERDICTS = ("YES", "MAYBE", "NO")


def parse_responses(answers: DataFrame, batch: str = "batch_id", answer: str = "answer") -> DataFrame:
    """One row per result of each answer, a code fence around it taken off: its texts, confidence, and malformed, the names of what is absent or of another type. An answer that isn't a list gives one row of nulls."""
    from lumenfold.functions.text import strip_code_fence

    r = answers.select(batch, F.explode_outer(F.from_json(strip_code_fence(F.col(answer)), "array<variant>")).alias("v"))
    own = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    wrong = [F.when(~F.schema_of_variant(own(n, "variant")).eqNullSafe(k), n) for n, k in (*((n, "STRING") for n in RESPONSE_TEXTS), ("confidence", "BIGINT"))]
    malformed = F.when(F.col("v").isNotNull(), F.filter(F.array(*wrong), lambda x: x.isNotNull()))
    return r.select(batch, *[own(n, "string").alias(n) for n in RESPONSE_TEXTS], own("confidence", "int").alias("confidence"), malformed.alias("malformed"))


def response_problems(results: DataFrame, manifest: DataFrame, batch: str = "batch_id", key: str = "pair_id") -> DataFrame:
    """(batch, problem, n): ids missing, extra or repeated, verdicts and confidences out of range, results with malformed fields."""
    r = results.where(F.col(key).isNotNull())
    seen = r.groupBy(batch, key).agg(F.count("*").alias("n"), F.count_if(F.size("malformed") > 0).alias("bad_fields"), F.count_if(~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False))).alias("bad_verdict"), F.count_if(~F.coalesce(F.col("confidence").between(1, 5), F.lit(False))).alias("bad_confidence"))
    j = manifest.select(batch, key).withColumn("_m", F.lit(True)).join(seen, [batch, key], "full")
    tests = {"missing": F.col("n").isNull(), "extra": F.col("_m").isNull(), "repeated": F.col("n") > 1, "verdict": F.col("bad_verdict") > 0, "confidence": F.col("bad_confidence") > 0, "fields": F.col("bad_fields") > 0}
    hit = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in tests.items()]), lambda x: x.isNotNull())
    return j.select(batch, F.explode(hit).alias("problem")).groupBy(batch, "problem").agg(F.count("*").alias("n"))


class QuotaError(Exception):
    """The service will take no more: stop, and resume later."""


class InvalidAnswer(Exception):
    """The answer came but doesn't fit the request."""


@dataclass
class Reply:
    """What a call may return instead of its results alone: also the answer's text and what it used."""

    results: list
    text: str | None = None
    usage: dict[str, int] = field(default_factory=dict)


def _digest(text: str | None) -> str | None:
    return None if text is None else hashlib.sha256(text.encode()).hexdigest()


def with_retry(call: Callable[[list], list | Reply], items: list, attempts: int = 4, base: float = 10.0, mode: str = "exponential", transient: tuple[type, ...] = (ConnectionError, TimeoutError), sleep: Callable[[float], None] = time.sleep, hint: Callable[[Exception], float | None] = lambda e: None, seed: int = 42, invalid_attempts: int = 1, check: Callable[[list, list], None] | None = None, render: Callable[[list], str] = lambda items: json.dumps(items, ensure_ascii=False, default=str), log: list | None = None) -> list:
    """call(items), again after transient errors and after answers that `check` or the call refuses (InvalidAnswer), each on a budget of its own: exponential, linear or jittered waits, or the server's own hint.

    log takes a row for each attempt: its number, status (completed, invalid, transient, failed), error, digests of prompt and answer, seconds waited after it, and usage.
    """
    jitter = random.Random(seed)
    log = [] if log is None else log
    prompt, failures = _digest(render(items)), {"transient": 0, "invalid": 0}
    budget = {"transient": attempts, "invalid": invalid_attempts}
    while True:
        row = {"attempt": len(log) + 1, "status": "failed", "error": None, "prompt_sha256": prompt, "answer_sha256": None, "waited": 0.0, "usage": {}}
        log.append(row)
        try:
            got = call(items)
            reply = got if isinstance(got, Reply) else Reply(got)
            row |= {"answer_sha256": _digest(reply.text), "usage": {k: v for k, v in reply.usage.items() if isinstance(v, int)}}
            if check:
                check(items, reply.results)
            row["status"] = "completed"
            return reply.results
        except Exception as e:  # what isn't retried is raised again below
            row["error"] = f"{type(e).__name__}: {e}"
            kind = "invalid" if isinstance(e, InvalidAnswer) else "transient" if isinstance(e, transient) else None
            if kind is None:
                raise
            row["status"] = kind
            failures[kind] += 1
            if failures[kind] >= budget[kind]:
                raise
            n = failures[kind] - 1
            wait = {"exponential": base * 2**n, "linear": base * (n + 1), "jitter": base * 2**n * (0.5 + jitter.random())}[mode]
            row["waited"] = float(hint(e) or wait)
        sleep(row["waited"])


def adaptive(call: Callable[..., list], items: list, split_on: tuple[type, ...] = (InvalidAnswer,), parent: int | None = None, log: list | None = None, path: str = "root", keep_attempts: bool = False) -> tuple[list, list[dict]]:
    """(results, request log): a request that fails for a reason of split_on is halved until it succeeds; a single item's failure and any other error stop everything.

    A node of the log has a path: root, root.L, root.L.R. With keep_attempts the call is given the node's list of attempts too.
    """
    log = [] if log is None else log
    node = {"node_id": len(log), "parent_id": parent, "path": path, "size": len(items), "error": None, "attempts": []}
    log.append(node)
    try:
        return (call(items, node["attempts"]) if keep_attempts else call(items)), log
    except Exception as e:
        node["error"] = f"{type(e).__name__}: {e}"
        if isinstance(e, QuotaError) or not isinstance(e, split_on) or len(items) < 2:
            raise
    half = len(items) // 2
    left, _ = adaptive(call, items[:half], split_on, node["node_id"], log, path + ".L", keep_attempts)
    right, _ = adaptive(call, items[half:], split_on, node["node_id"], log, path + ".R", keep_attempts)
    return left + right, log


def call_batches(batches: DataFrame, call: Callable[[list], list | Reply], split_on: tuple[type, ...] = (InvalidAnswer,), **retry) -> DataFrame:
    """(batch_id, results JSON, requests JSON, error) of each batch (batch_id, members). A batch whose call ends in an error has no results and is tried again on the next run."""

    def run(frames):
        import pandas as pd

        def one(items, attempts):
            return with_retry(call, items, log=attempts, **retry)

        for pdf in frames:
            rows = []
            for batch_id, members in zip(pdf["batch_id"], pdf["members"], strict=True):
                log: list[dict] = []
                try:
                    results, _ = adaptive(one, list(members), split_on, None, log, keep_attempts=True)
                    rows.append((batch_id, json.dumps(results, ensure_ascii=False), json.dumps(log), None))
                except Exception as e:  # noqa: BLE001 - the batch's outcome, whatever it was, is what is recorded
                    rows.append((batch_id, None, json.dumps(log), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["batch_id", "results", "requests", "error"])

    return batches.select("batch_id", "members").mapInPandas(run, "batch_id string, results string, requests string, error string")


ATTEMPT = "struct<attempt int, status string, error string, prompt_sha256 string, answer_sha256 string, waited double, usage map<string, bigint>>"


def request_totals(outcomes: DataFrame) -> DataFrame:
    """Requests, failed requests and items sent, over all request logs."""
    log = F.from_json("requests", "array<struct<node_id int, parent_id int, size int, error string>>")
    each = outcomes.select(F.explode(log).alias("r"))
    return each.agg(F.count("*").alias("requests"), F.count("r.error").alias("failed"), F.sum("r.size").cast("long").alias("items"))


def attempts(outcomes: DataFrame) -> DataFrame:
    """(batch_id, path, attempt, status, error, prompt_sha256, answer_sha256, waited, usage): one row per attempt of each request."""
    log = F.from_json("requests", f"array<struct<path string, attempts array<{ATTEMPT}>>>")
    return outcomes.select("batch_id", F.explode(log).alias("r")).select("batch_id", F.col("r.path").alias("path"), F.explode("r.attempts").alias("a")).select("batch_id", "path", "a.*")


def usage_tree(tried: DataFrame) -> DataFrame:
    """(batch_id, path, requests, usage) of attempts: a node's attempts and usage with those of all nodes below it.

    An attempt counts for each node on its way to the root, which its path spells; a batch halved down to
    single items is as deep as the logarithm of its size. Sums are partial before the shuffle; the root's row holds the batch's totals.
    """
    steps = F.split("path", r"\.")
    up = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "."))
    each = tried.select("batch_id", F.explode(up).alias("path"), "usage")
    count = each.select("batch_id", "path", F.explode(F.map_concat(F.create_map(F.lit(""), F.lit(1).cast("long")), F.coalesce("usage", F.expr("cast(map() as map<string, bigint>)")))).alias("field", "n"))
    sums = count.groupBy("batch_id", "path", "field").agg(F.sum("n").alias("n"))
    entries = F.array_sort(F.collect_list(F.when(F.col("field") != "", F.struct("field", "n"))))
    return sums.groupBy("batch_id", "path").agg(F.max(F.when(F.col("field") == "", F.col("n"))).alias("requests"), F.map_from_entries(entries).alias("usage"))


def fingerprint(**settings) -> str:
    """Digest of what a run depends on; a checkpoint of another fingerprint is not resumed."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str).encode()).hexdigest()


def pending(batches: DataFrame, done: DataFrame | None, run: str) -> DataFrame:
    """Batches without a good result in the checkpoint; whole batches only. Another run's checkpoint is an error."""
    if done is None:
        return batches
    other = done.where(F.col("fingerprint") != run).limit(1).collect()
    if other:
        raise ValueError("the checkpoint belongs to a run with other settings")
    return batches.join(done.where("error is null").select("batch_id").distinct(), "batch_id", "left_anti")


def run_resumable(batches: DataFrame, path: str, run: str, process: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Appends the outcomes of the pending batches to the Parquet checkpoint at path, with the number of the attempt, and returns the good ones of the latest attempt of each batch."""
    spark = batches.sparkSession
    store = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = store.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(store)
    done = spark.read.parquet(path) if there else None
    attempt = 1 + (done.agg(F.coalesce(F.max("attempt"), F.lit(0))).first()[0] if there else 0)
    process(pending(batches, done, run)).withColumn("fingerprint", F.lit(run)).withColumn("attempt", F.lit(attempt).cast("long")).write.mode("append").parquet(path)
    latest = F.row_number().over(Window.partitionBy("batch_id").orderBy(F.desc("attempt")))
    return spark.read.parquet(path).where("error is null").withColumn("_n", latest).where("_n = 1").drop("_n")


def manifest_problems(pairs: DataFrame, batches: DataFrame, size: int, key: str = "pair_id") -> DataFrame:
    """(code, error) of what is wrong with a pair manifest (key, index) and its batches: a repeated key, indices that aren't 0..n-1, batches that aren't full (but the last), don't follow each other, hold other members than the pairs say, or whose digest is another."""
    n, b = pairs.agg(F.count("*")).scalar(), F.col("batch_index")
    row = lambda df, code, what: df.select(F.lit(code).alias("code"), F.col(what).cast("string").alias("error"))
    repeated = pairs.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    gaps = pairs.groupBy("index").agg(F.count("*").alias("n")).where((F.col("n") > 1) | ~F.col("index").between(0, n - 1))
    full = F.least(F.lit(size), n - b * size)
    shape = batches.where((F.col("size") != full) | (F.col("start_index") != b * size) | (F.size("members") != F.col("size")))
    count = batches.agg(F.count("*").alias("n")).where(F.col("n") != F.ceil(n / size))
    digest = batches.where(F.sha2(F.to_json("members"), 256) != F.col("membership_sha256"))
    held = batches.select(F.posexplode("members").alias("_p", "_m"), "start_index").select((F.col("start_index") + F.col("_p")).alias("index"), "_m")
    moved = pairs.select("index", F.col(key).cast("string").alias("_k")).join(held, "index", "full").where(~F.col("_k").eqNullSafe(F.col("_m")))
    out = row(repeated, "pair_repeated", key)
    for part in (row(gaps, "index", "index"), row(shape, "batch_shape", "batch_id"), row(count, "batch_count", "n"), row(digest, "batch_digest", "batch_id"), row(moved, "batch_member", "index")):
        out = out.unionAll(part)
    return out


def content_digest(df: DataFrame, order: Sequence[str]) -> str:
    """SHA-256 over the digests of all rows' canonical JSON in order; rows are digested where they lie, their digests in blocks of a numbering."""
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    numbered = pair_manifest(df.select(*order, row.alias("_d")), order).select((F.col("index") / 4096).cast("long").alias("_b"), "index", "_d")
    blocks = numbered.groupBy("_b").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "_d"))), lambda s: s["_d"]), ""), 256).alias("_d"))
    whole = hashlib.sha256()
    for r in blocks.orderBy("_b").toLocalIterator():
        whole.update(r["_d"].encode())
    return whole.hexdigest()


def _found(checks: dict[str, Column]) -> list[Column]:
    return [F.coalesce(F.bool_or(bad), F.lit(False)).alias(name) for name, bad in checks.items()]


def preflight(checks: dict[str, tuple[DataFrame, Column]]) -> list[str]:
    """Names of the checks of which a row is bad, in order; each table is read once for all its checks, and all tables in one action."""
    tables: dict[int, tuple[DataFrame, dict[str, Column]]] = {}
    for name, (df, bad) in checks.items():
        tables.setdefault(id(df), (df, {}))[1][name] = bad
    out = None
    for df, own in tables.values():
        row = df.agg(*_found(own)).select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("bad")) for n in own])).alias("x")).select("x.*")
        out = row if out is None else out.unionAll(row)
    bad = {r["name"] for r in out.where("bad").collect()} if out is not None else set()  # a row per check
    return [n for n in checks if n in bad]


def watched(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, Callable[[], list[str]]]:
    """(df, verdict): the checks are observed on the pass that whoever uses df makes anyway; after that action verdict() names those of which a row was bad."""
    seen = Observation()
    return df.observe(seen, *_found(checks)), lambda: [n for n in checks if seen.get[n]]
