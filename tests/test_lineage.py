import random

import pytest

from tablekeeper.operators import chunks, lineage, retention, snapshot
from tablekeeper.sources import catalogue, event_log, files
from tablekeeper.streaming import counts

GROUP = ["server_id", "profile"]


def walk(rows):
    """Resolve each run against the runs before it, one after another."""
    done = {}
    state = {}
    for r in sorted(rows, key=lambda r: (r[4], r[5], r[0])):
        run, server, profile, mode = r[:4]
        seen = state.setdefault((server, profile), [])
        if mode == "differential":
            parent = next((p for p in reversed(seen) if done[p][0] == "full"), None)
        elif mode == "incremental":
            parent = seen[-1] if seen else None
        else:
            parent = None
        done[run] = (mode, parent, done[parent][2] + [parent]) if parent else ("full", None, [])
        seen.append(run)
    return done


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    return [
        (f"r{i:04d}", "s", "hot" if rng.random() < 0.5 else f"p{rng.randrange(5)}",
         rng.choices(["full", "differential", "incremental"], [1, 3, 8])[0],
         rng.randrange(200) * 1000, rng.randrange(3), "chunked")
        for i in range(400)
    ]


def frame(spark, rows):
    return spark.createDataFrame(
        rows, "run_id string, server_id string, profile string, requested_mode string, "
        "finished_ms long, mtime_ms long, compression string")


@pytest.mark.parametrize("rows_per_task", [10_000, 20])
def test_history_and_chains(spark, rows, rows_per_task):
    want = walk(rows)
    history = lineage.lineage(frame(spark, rows), GROUP, rows_per_task).cache()
    for r in history.collect():
        kind, parent, chain = want[r.run_id]
        assert (r.backup_type, r.parent_run_id, r.depth) == (kind, parent, len(chain)), r
        assert r.root_id == (chain[0] if chain else None)
    chains = {}
    for r in lineage.chain_members(history, history, GROUP).orderBy("for_run", "step").collect():
        chains.setdefault(r.for_run, []).append(r.member)
    assert chains == {run: chain for run, (_, _, chain) in want.items() if chain}


@pytest.mark.parametrize("rows_per_task", [10_000, 20])
@pytest.mark.parametrize("share", [0.02, 0.3])
def test_broken_chains(spark, rows, rows_per_task, share):
    rng = random.Random(7)
    deleted = {r[0] for r in rows if rng.random() < share}
    want = {}
    for run, (_, _, chain) in walk(rows).items():
        lost = [m for m in chain if m in deleted]
        if run not in deleted and lost:
            want[run] = lost[-1]
    history = lineage.lineage(frame(spark, rows), GROUP)
    gone = spark.createDataFrame([(d,) for d in deleted], "run_id string")
    got = lineage.broken_chains(history, gone, GROUP, rows_per_task).collect()
    assert {r.run_id: r.nearest_missing for r in got} == want


def test_next_parent(spark, rows):
    history = lineage.lineage(frame(spark, rows), GROUP)
    done = walk(rows)
    last = max((r for r in rows if r[2] == "hot"), key=lambda r: (r[4], r[5], r[0]))[0]
    full = max((r for r in rows if r[2] == "hot" and done[r[0]][0] == "full"),
               key=lambda r: (r[4], r[5], r[0]))[0]
    new = spark.createDataFrame(
        [("a", "s", "hot", "incremental"), ("b", "s", "hot", "differential"),
         ("c", "s", "hot", "full"), ("d", "s", "none", "incremental")],
        "run_id string, server_id string, profile string, requested_mode string")
    got = {r.run_id: r for r in lineage.resolve_parent(new, history, GROUP).collect()}
    assert (got["a"].backup_type, got["a"].parent_run_id) == ("incremental", last)
    assert got["a"].depth == len(done[last][2]) + 1
    assert (got["b"].parent_run_id, got["b"].depth) == (full, 1)
    assert (got["c"].backup_type, got["c"].parent_run_id) == ("full", None)
    assert (got["d"].backup_type, got["d"].parent_run_id, got["d"].depth) == ("full", None, 0)


def test_a_run_is_not_its_own_parent(spark):
    rows = [("a", "s", "p", "incremental", 1000, 1, "chunked"), ("b", "s", "p", "incremental", 2000, 2, "chunked"),
            ("z", "s", "p", "full", 3000, 3, "gzip")]
    history = lineage.lineage(frame(spark, rows), GROUP)
    new = spark.createDataFrame([("b", "s", "p", "incremental")],
                                "run_id string, server_id string, profile string, requested_mode string")
    assert lineage.resolve_parent(new, history, GROUP).first().parent_run_id == "a"
    assert {r.run_id for r in history.collect()} == {"a", "b"}


def test_new_runs_of_one_text_are_one_row(spark):
    """Where all new runs have one id there is no key to join by: stored runs must not meet every new run."""
    stored = spark.range(300).selectExpr(
        "'r' || id AS run_id", "'s' || id AS server_id", "'p' AS profile", "'chunked' AS compression",
        "'full' AS backup_type", "id AS finished_ms", "id AS mtime_ms", "0L AS depth")
    new = spark.range(400).selectExpr(
        "'next' AS run_id", "'s' || id AS server_id", "'p' AS profile", "'incremental' AS requested_mode")
    got = lineage.resolve_parent(new, stored, GROUP)
    rows = got.collect()
    assert {(r.server_id, r.parent_run_id) for r in rows} == {
        (f"s{i}", f"r{i}" if i < 300 else None) for i in range(400)} and len(rows) == 400
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    join = next(i for i, line in enumerate(plan) if "Join LeftAnti" in line)
    other = plan[join].index("Join LeftAnti")  # the right side is the last branch below the join
    right = next(line for line in plan[join + 1:] if line[other:].startswith("+- "))
    assert right[other + 3:].startswith("Aggregate")


def test_retention(spark):
    day = retention.DAY_MS
    rows = [("a", "s", "p", "full", 1 * day, 1, "gzip"), ("b", "s", "p", "full", 2 * day, 1, "gzip"),
            ("c", "s", "p", "full", 3 * day, 1, "gzip"), ("d", "s", "q", "full", 1 * day, 1, "gzip")]
    catalog = frame(spark, rows)
    profiles = catalog.select("profile").distinct()
    policies = retention.resolve_policies(
        profiles, [{"profile": "p", "keep_last": 2}, {"profile": "q", "max_age_days": 9}],
        {"max_age_days": 5})
    plan = retention.deletion_plan(catalog, policies, ["profile"], 7 * day)
    # the cutoff is strict, and q's own age beats the default
    assert {r.run_id: r.reasons for r in plan.collect()} == {"a": ["keep_last", "max_age_days"]}
    assert {r.run_id for r in retention.survivors(catalog, plan).collect()} == {"b", "c", "d"}
    assert retention.resolve_policies(profiles, []).count() == 0
    summary = retention.policy_summary(catalog, policies.filter("profile = 'p'"), plan)
    assert {(r.profile, r.configured, r.total_runs, r.pending_deletions) for r in summary.collect()} == {
        ("p", True, 3, 1), ("q", False, 1, 0)}


def test_retention_by_count_only(spark):
    rows = [(c, "s", "p", "full", i, 0, "gzip") for i, c in enumerate("abc")]
    catalog = frame(spark, rows)
    policies = retention.resolve_policies(catalog.select("profile").distinct(), [], {"keep_last": 2})
    assert [r.run_id for r in retention.over_count(catalog, policies, ["profile"]).collect()] == ["a"]
    assert retention.over_age(catalog, policies, 10**12).count() == 0


@pytest.mark.parametrize("policy", [{}, {"keep_last": 0}, {"max_age_days": -1}])
def test_bad_policies(policy):
    with pytest.raises(ValueError):
        retention.check_policy(policy)


def test_apply_retention_twice(spark, tmp_path):
    """The second call finds nothing to do: no event, no new version of the catalogue."""
    root, log, store = (str(tmp_path / name) for name in ("catalog", "log", "store"))
    rows = [("a", "s", "p", "full", 1, 1, "gzip"), ("b", "s", "p", "full", 2, 1, "gzip")]
    files.publish(frame(spark, rows), root)
    artifacts = spark.createDataFrame(
        [("a", "p", 1, b"old bytes"), ("b", "p", 2, b"new bytes")],
        "run_id string, profile string, run_seq long, content binary")
    blocks = chunks.chunk(artifacts, 4, with_data=True)
    chunks.append_store(blocks, store)
    policies = retention.resolve_policies(frame(spark, rows).select("profile").distinct(), [], {"keep_last": 1})
    for _ in range(2):
        left = retention.apply_retention(
            spark, root, policies, ["profile"], 10, log, "00:00:00 2024-01-31", store, blocks.drop("data"))
        assert [r.run_id for r in left.collect()] == ["b"]
        events = {(r.event, r.payload_json) for r in event_log.scan_events(spark, log).collect()}
        # "old ", "byte" and "s" against "new ", "byte" and "s": one block goes
        assert {e for e, _ in events} == {"retention.deleted", "retention.chunks_gc"} and len(events) == 2
        assert '{"profile":"p","chunks_deleted":1}' in {p for _, p in events} or '{"chunks_deleted":1,"profile":"p"}' in {
            p for _, p in events}
        assert chunks.list_store(chunks.read_store(spark, store)).count() == 3
    assert files.complete_versions(spark, root) == [1, 2]


STEPS = ["note_intent", "log_intent", "publish_intent", "collect_garbage", "collect_intent", "carry_out"]


@pytest.mark.parametrize("last", STEPS)
def test_retention_cut_off_after_each_step(spark, tmp_path, monkeypatch, last):
    """A call that ends after a step is finished by the next: one event per deletion, no garbage left."""
    root, log, store = (str(tmp_path / name) for name in ("catalog", "log", "store"))
    rows = [(name, "s", "p", "full", n, 1, "gzip") for n, name in enumerate("abc")]
    files.publish(frame(spark, rows), root)
    artifacts = spark.createDataFrame(
        [("a", "p", 1, b"old bytes"), ("b", "p", 2, b"older bytes!"), ("c", "p", 3, b"new bytes")],
        "run_id string, profile string, run_seq long, content binary")
    blocks = chunks.chunk(artifacts, 4, with_data=True)
    chunks.append_store(blocks, store)
    policies = retention.resolve_policies(frame(spark, rows).select("profile").distinct(), [], {"keep_last": 1})

    def apply():
        return retention.apply_retention(
            spark, root, policies, ["profile"], 10, log, "00:00:00 2024-01-31", store, blocks.drop("data"))

    owner = chunks if last == "collect_garbage" else retention
    step = getattr(owner, last)

    def cut_off(*args, **more):
        step(*args, **more)
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(owner, last, cut_off)
        with pytest.raises(RuntimeError):
            apply()
    for _ in range(2):
        assert [r.run_id for r in apply().collect()] == ["c"]
    events = [(r.event, r.payload_json) for r in event_log.scan_events(spark, log).collect()]
    assert sorted(e for e, _ in events) == ["retention.chunks_gc"] + ["retention.deleted"] * 2
    assert len(set(events)) == 3 and any('"chunks_deleted":4' in p for _, p in events)
    assert chunks.garbage(chunks.read_store(spark, store), blocks.filter("run_id = 'c'")).isEmpty()
    assert retention.open_intents(spark, root) == []


def test_nothing_there_yet(spark, tmp_path):
    """Absent logs, stores, catalogues and counts are empty, with their columns."""
    root = str(tmp_path / "none")
    assert event_log.scan_events(spark, root).select("at", "event", "payload.profile", "line_no").count() == 0
    assert chunks.list_store(chunks.read_store(spark, root)).count() == 0
    assert chunks.collect_garbage(spark, root, chunks.read_store(spark, root)) == 0
    for profiles in (None, ["p"]):
        assert catalogue.scan_manifests(spark, root, profiles).select("run_id", "finished_ms").count() == 0
        assert catalogue.scan_run_folders(spark, root, profiles).select("run_dir", "profile").count() == 0
    assert snapshot.catalog_of(spark, root).count() == 0
    assert counts.read_counts(spark, root).select("profile", "n").count() == 0
    policies = spark.createDataFrame([("p", 1, None)], "profile string, keep_last long, max_age_days long")
    left = retention.apply_retention(spark, root, policies, ["server_id", "profile"], 1, root, "00:00:00 2024-01-31")
    assert left.count() == 0 and "server_id" in left.columns
