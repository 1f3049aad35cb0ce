"""End-to-end run of the plans over the test tables (default: sf0.001).

    python examples/end_to_end.py [/root/testdata/sf0.001]

Prep (rows + frequencies + draft vocabulary) → Examples (packed, collated
batches) → Backfill (states from ``embeddings`` for the rows not yet stored) →
Regen (replies from the assistant turns).  Outputs go to a fresh scratch folder.
"""

from __future__ import annotations

import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from draftsmith.operators.vocab import token_frequency  # noqa: E402
from draftsmith.plans.backfill import backfill  # noqa: E402
from draftsmith.plans.examples import build_training_batches  # noqa: E402
from draftsmith.plans.prepare import prepare_turns, resolve_vocab, write_frequencies, write_prepared  # noqa: E402
from draftsmith.session import local_session  # noqa: E402
from draftsmith.tables import table  # noqa: E402


def main(sf: str) -> None:
    spark = local_session(8, 8, app="draftsmith-example")
    out = tempfile.mkdtemp(prefix="draftsmith-example-")
    raw = table(spark, sf, "conversations", "conv_id", "turn", "role", "text")

    # Prep
    write_prepared(prepare_turns(raw, minimum_valid_tokens=1), f"{out}/prepared")
    rows = spark.read.parquet(f"{out}/prepared")
    write_frequencies(token_frequency(rows), f"{out}/token_freq")
    d2t, _ = resolve_vocab(spark, cache_dir=f"{out}/vocab", freq=spark.read.parquet(f"{out}/token_freq"), draft_vocab_size=1024)
    print("prepared rows:", rows.count(), "draft vocabulary:", d2t.count())

    # Examples
    batches = build_training_batches(rows, 2048, 2, seed=0, step="shift", anchors=(8, 4, 131072))
    batches.write.mode("overwrite").parquet(f"{out}/batches")
    print("training batches:", spark.read.parquet(f"{out}/batches").count())

    # Backfill: artefacts exist for the ids present in `labels`
    existing = table(spark, sf, "labels", "doc_id").select(F.col("doc_id").alias("sample_id"))
    vec = table(spark, sf, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("sample_id"), "embedding")

    def states(todo):  # stands for a serving endpoint: one state per token, the sample's vector
        return todo.join(vec, "sample_id").select("sample_id", F.col("input_ids").alias("token_ids"), F.transform("input_ids", lambda _: F.col("embedding")).alias("hidden_states"))

    made = backfill(spark, rows, existing, states, store=f"{out}/artefacts")
    print("artefacts generated:", made.count())

    # Regen
    from draftsmith.plans.regenerate import regenerate_dataset
    from draftsmith.sources.conversations import RAW_SCHEMA, turn_struct

    convs = raw.groupBy(F.col("conv_id").alias("idx")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda t: turn_struct(t["role"], t["text"])).alias("conversations")
    )
    src = convs.select(*[F.col(f.name) if f.name in convs.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in RAW_SCHEMA.fields])
    said = raw.filter("role = 'assistant'").select(F.concat(F.lit("sample_"), F.col("conv_id").cast("string")).alias("sample_id"), (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    res = regenerate_dataset(spark, src, lambda prompts: said, f"{out}/regen")
    print("regenerated:", {r.status: r.n for r in res.groupBy("status").agg(F.count("*").alias("n")).collect()})
    print("outputs in", out)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001")
