"""Benchmark the headline queries.

Runs each headline query at ``$BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``)
on ``local[$BENCH_CPUS]``: one warm-up run, then ``$BENCH_REPS`` timed runs
(median reported).  Every run executes the full plan into Spark's ``noop``
sink (nothing is collected to the driver).  Input records and shuffle bytes
per run are read back from Spark's event log (written to a fresh scratch
folder; each query's jobs carry its name as job group).  Prints ONE JSON line.
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    # prep pipeline
    "prepare_rows",
    "token_frequency",
    "draft_vocab_topk",
    "tokenize_offsets",
    "loss_mask",
    "turn_dropout",
    # examples / packing / sampling
    "collate_document_ids",
    "anchor_blocks",
    "mtp_targets",
    "pack_batches",
    "cod_sampling",
    # quality
    "loss_kl",
    "compound_loss",
    "confidence_calibration",
    "conditional_accuracy",
    # evaluation / logs
    "acceptance_metrics",
    "speedup_interpolated",
    "failure_streaks",
    "resume_anti_join",
    "regen_error_split",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from draftsmith.catalog import load_all
    from draftsmith.session import local_session

    event_dir = tempfile.mkdtemp(prefix="draftsmith-eventlog-")
    os.environ["DRAFTSMITH_EVENT_LOG"] = f"file://{event_dir}"
    spark = local_session(cpus, max(8, 2 * cpus), app="draftsmith-bench")
    reg = load_all()
    names = only or HEADLINE
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in names:
        fn = reg[name].fn
        spark.sparkContext.setJobGroup(f"warm:{name}", name)
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        spark.sparkContext.setJobGroup(f"run:{name}", name)
        samples = []
        for _ in range(reps):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)
        print(f"[bench] {name}: {times[name]}s", file=sys.stderr)

    # end-to-end Prep job (raw turns → prepared rows written as Parquet), the
    # reference's "preprocess N samples" yardstick: conversations per second
    from draftsmith.plans.prepare import prepare_turns, write_prepared
    from draftsmith.tables import table

    n_conv = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().count()
    rows["conversations"] = n_conv
    raw = lambda: table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    spark.sparkContext.setJobGroup("prep-e2e", "prep-e2e")
    write_prepared(prepare_turns(raw()), tempfile.mkdtemp(prefix="draftsmith-prep-") + "/rows", overwrite=True)  # warm-up
    e2e = []
    for _ in range(reps):
        out_dir = tempfile.mkdtemp(prefix="draftsmith-prep-") + "/rows"
        t0 = time.perf_counter()
        write_prepared(prepare_turns(raw()), out_dir, overwrite=True)
        e2e.append(time.perf_counter() - t0)
    prep = statistics.median(e2e)
    total = round(sum(times.values()), 3)
    out = {
        "metric": "headline_total_seconds",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "cpus": cpus,
        "reps": reps,
        "prep_e2e_sec": round(prep, 3),
        "prep_conversations_per_sec": round(n_conv / prep, 1) if prep else None,
        "n_conversations": n_conv,
    }
    spark.stop()
    io = _io_from_event_log(event_dir, reps)
    out["input_rows"] = {q: io[q][0] for q in times if q in io}
    out["shuffle_bytes"] = {q: io[q][1] for q in times if q in io}
    print(json.dumps(out))


def _io_from_event_log(event_dir: str, reps: int) -> dict:
    """Per query: (input records, shuffle bytes written) per timed run."""
    stage_group: dict[int, str] = {}
    totals: dict[str, list[int]] = {}
    for path in sorted(glob.glob(os.path.join(event_dir, "**", "*"), recursive=True)):
        if os.path.isdir(path):
            continue
        with open(path) as f:
            for line in f:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (ev.get("Properties") or {}).get("spark.jobGroup.id", "")
                    for sid in ev.get("Stage IDs", []):
                        stage_group[sid] = group
                elif kind == "SparkListenerTaskEnd":
                    group = stage_group.get(ev.get("Stage ID"), "")
                    if not group.startswith("run:"):
                        continue
                    m = ev.get("Task Metrics") or {}
                    t = totals.setdefault(group[4:], [0, 0])
                    t[0] += (m.get("Input Metrics") or {}).get("Records Read", 0)
                    t[1] += (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
    return {q: (v[0] // max(reps, 1), v[1] // max(reps, 1)) for q, v in totals.items()}


if __name__ == "__main__":
    main()
