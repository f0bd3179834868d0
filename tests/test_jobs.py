"""The stateful job stream against the batch table."""

import random
import time

from lacuna.streaming import events, jobs

PATH = ["FETCHING", "PREPROCESSING", "RECONSTRUCTING", "ANALYZING", "COMPLETED"]


def changes(seed, n):
    r = random.Random(seed)
    rows = []
    for job in range(n):
        steps = PATH[: r.randrange(1, 6)]
        if r.random() < 0.3:
            steps.insert(1, "PARTIAL")
        if r.random() < 0.3:
            steps.insert(r.randrange(len(steps) + 1), r.choice([*PATH, "QUEUED"]))  # mostly not allowed there
        if r.random() < 0.2:
            steps.append("FAILED")
        rows += [(job, k, s) for k, s in enumerate(steps)]
    return rows


def reached(spark, query, out, done, seconds=70):
    """The table below `out` once `done` holds of it; the query is stopped."""
    start, got = time.time(), []
    try:
        while time.time() - start < seconds:
            assert query.exception() is None
            try:
                got = sorted(map(tuple, jobs.table(spark, out).collect()))
            except Exception:  # a batch is being written
                got = []
            if done(got):
                break
            time.sleep(0.5)
    finally:
        query.stop()
    return got


def test_shuffled_repeated_batches_end_in_the_batch_table(spark, tmp_path):
    rows = changes(1, 40)
    df = spark.createDataFrame(rows, "job_id bigint, seq int, state string")
    want = sorted(map(tuple, events.job_states(df).collect()))
    r = random.Random(2)
    mixed = rows + r.sample(rows, 60)
    r.shuffle(mixed)
    for k in range(4):
        part = mixed[k::4] + [(None, 1, "FETCHING"), (3, None, "FAILED")]
        spark.createDataFrame(part, df.schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    query = jobs.keep(jobs.job_stream(live, 3_600_000), out, mark)
    assert reached(spark, query, out, lambda got: got == want) == want and len({w[1] for w in want}) > 4
    # a batch that is delivered again changes nothing
    again = spark.read.schema(jobs.OUT).parquet(f"{out}/batch=1").collect()
    jobs.put(spark.createDataFrame(again, jobs.OUT), 1, out)
    assert sorted(map(tuple, jobs.table(spark, out).collect())) == want


def test_a_late_source_makes_a_job_partial(spark, tmp_path):
    kind = "job_id bigint, seq int, state string"

    def arrive(k, rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))

    def run(done):
        live = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        query = jobs.keep(jobs.job_stream(live, 1), str(tmp_path / "out"), str(tmp_path / "mark"))
        return {job: state for job, state, _ in reached(spark, query, str(tmp_path / "out"), lambda got: done({x[0]: x[1] for x in got}))}

    arrive(0, [(1, 0, "FETCHING"), (2, 0, "FETCHING"), (2, 1, "PREPROCESSING")])
    got = run(lambda got: got.get(1) == "PARTIAL")
    assert got == {1: "PARTIAL", 2: "PREPROCESSING"}
    arrive(1, [(1, 1, "PREPROCESSING")])  # the source has come after all
    assert run(lambda got: got.get(1) == "PREPROCESSING") == {1: "PREPROCESSING", 2: "PREPROCESSING"}
