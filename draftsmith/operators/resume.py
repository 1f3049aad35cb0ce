"""Resume, backfill and artefact checks.

All set logic is joins on the sample id: Catalyst plans a broadcast hash
join when the existing-id side is small and a sort-merge join otherwise;
AQE switches at runtime from the real sizes.  Nothing is collected to the
driver — the reference keeps these sets in Python memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftsmith.functions.batches import runs
from draftsmith.operators.ranking import chunk_of, id_rank

POLICIES = ("generate", "skip", "warn", "raise")


def missing_ids(todo: DataFrame, existing: DataFrame, key: str = "sample_id") -> DataFrame:
    """Rows of ``todo`` whose key is not in ``existing`` (left anti)."""
    return todo.join(existing.select(key), key, "left_anti")


def present_ids(todo: DataFrame, existing: DataFrame, key: str = "sample_id") -> DataFrame:
    """Rows of ``todo`` whose key is in ``existing`` (left semi)."""
    return todo.join(existing.select(key), key, "left_semi")


def assign_chunks(ids: DataFrame, world_size: int, max_samples: int | None = None, key: str = "sample_id") -> DataFrame:
    """index = rank of the key; owner rank of each of the first ``min(max, n)`` indices.

    ``n`` is one count action (a scalar).  Rows beyond the target are dropped,
    as in the reference; chunks differ by at most one.
    """
    n = ids.count()
    target = n if max_samples is None else min(max_samples, n)
    ranked = id_rank(ids, key, "idx")
    return ranked.withColumn("owner", chunk_of(F.col("idx"), target, world_size)).filter(F.col("owner").isNotNull())


def backfill_plan(ids: DataFrame, existing: DataFrame, world_size: int, max_samples: int | None = None, key: str = "sample_id") -> DataFrame:
    """Q7 (follow the code): existing rows are taken out of the first ``max`` indices."""
    return missing_ids(assign_chunks(ids, world_size, max_samples, key), existing, key)


def existing_per_chunk(chunks: DataFrame, existing: DataFrame, key: str = "sample_id") -> DataFrame:
    """J3 + count: ``(owner, n_existing, n_total)`` per rank chunk."""
    flagged = chunks.join(existing.select(key, F.lit(1).alias("_e")), key, "left")
    return flagged.groupBy("owner").agg(
        F.count(F.col("_e")).alias("n_existing"), F.count(F.lit(1)).alias("n_total")
    )


def attach_artefacts(rows: DataFrame, artefacts: DataFrame, policy: str = "generate", key: str = "sample_id") -> DataFrame:
    """Left join rows to artefacts; ``status`` says what happens to a missing one.

    ``generate`` → status ``generate`` (route to the generator / J2 set),
    ``skip`` and ``warn`` → row removed (the rows to warn about are
    :func:`missing_ids`), ``raise`` → the query fails at run time (``raise_error``).
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}; choose one of {POLICIES}")
    a = artefacts.withColumn("_has", F.lit(True))
    j = rows.join(a, key, "left")
    has = F.col("_has").isNotNull()
    if policy in ("skip", "warn"):
        return j.filter(has).withColumn("status", F.lit("present")).drop("_has")
    if policy == "raise":
        # a filter predicate, so the check cannot be pruned away with a column
        fail = F.raise_error(F.concat(F.lit("missing artefact for "), F.col(key).cast("string"))).isNull()
        return j.filter(F.when(has, F.lit(True)).otherwise(fail)).withColumn("status", F.lit("present")).drop("_has")
    status = F.when(has, F.lit("present")).otherwise(F.lit("generate"))
    return j.withColumn("status", status.cast("string")).drop("_has")


def validate_artefacts(rows: DataFrame, artefacts: DataFrame, key: str = "sample_id") -> DataFrame:
    """Token ids equal, no NaN in the states, lengths equal → ``(ok, reason)``.

    ``artefacts(key, token_ids array<bigint>, hidden_states array<array<float>>)``
    (one vector per position; the layer axis may be flattened into it).
    """
    j = rows.select(key, "input_ids").join(artefacts, key, "inner")
    nan = F.exists("hidden_states", lambda v: F.exists(v, lambda x: x.isNull() | F.isnan(x)))  # a NaN may come as null through Arrow
    reason = (
        F.when(F.col("token_ids") != F.col("input_ids"), F.lit("token ids differ"))
        .when(nan, F.lit("nan in hidden states"))
        .when(F.size("hidden_states") != F.size("input_ids"), F.lit("length differs"))
    )
    return j.select(key, reason.isNull().alias("ok"), reason.alias("reason"))


def artefact_index(paths: DataFrame, path_col: str = "path", prefix: str = "hs_", suffix: str = ".safetensors") -> DataFrame:
    """``hs_<int>.safetensors`` names → sorted distinct indices; others skipped."""
    name = F.regexp_extract(F.col(path_col), r"([^/]+)$", 1)
    pat = "^" + prefix.replace(".", r"\.") + r"([0-9]+)" + suffix.replace(".", r"\.") + "$"
    idx = F.regexp_extract(name, pat, 1)
    return paths.select(F.when(idx != "", idx.cast("bigint")).alias("sample_id")).filter(F.col("sample_id").isNotNull()).distinct()


# Tokens whose states a generator makes at a time.
PART_TOKENS = 1 << 16


def artefact_generator(
    fn,
    schema: str = "sample_id bigint, token_ids array<bigint>, hidden_states array<array<float>>",
    part_tokens: int = PART_TOKENS,
):
    """Wrap a user callable ``fn(pandas.DataFrame(sample_id, input_ids)) ->
    pandas.DataFrame(schema)`` (e.g. a client of a serving endpoint) as a
    ``DataFrame -> DataFrame`` generator for :func:`draftsmith.plans.backfill.backfill`.

    It runs in ``mapInPandas`` on runs of rows of ``part_tokens`` tokens (a longer row
    alone), because states are many times the size of the ids of an Arrow batch; keep
    ``fn`` pure per row so a retried task produces the same artefacts (the write commits
    once).
    """

    def run(batches):
        for pdf in batches:
            for first, n in runs([0 if ids is None else len(ids) for ids in pdf["input_ids"]], part_tokens):
                yield fn(pdf.iloc[first : first + n].reset_index(drop=True))

    return lambda rows: rows.select("sample_id", "input_ids").mapInPandas(run, schema)
