"""Prep job: raw chats → prepared rows + token frequencies + draft vocabulary.

One lazy DAG per output; the writes are the only actions.  Shuffles: the
conversation id (assembling rows), the md5 bucket (seeded cap, only when a
cap is asked for) and the token id (frequencies).
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftsmith.functions.text import CHATML, DEFAULT_VOCAB_SIZE, ChatTemplate
from draftsmith.operators.normalize import normalize_turns
from draftsmith.operators.ranking import shuffle_cap
from draftsmith.operators.tokenize import prepare_rows
from draftsmith.operators.vocab import combine_frequencies, select_draft_tokens, token_frequency, vocab_maps
from draftsmith.tables import table


def prepare_turns(
    turns: DataFrame | list[DataFrame],
    template: ChatTemplate = CHATML,
    max_length: int = 8192,
    vocab_size: int = DEFAULT_VOCAB_SIZE,
    minimum_valid_tokens: int | None = None,
    turn_dropout: bool = False,
    seed: int = 0,
    max_samples: int | None = None,
    id_col: str = "conv_id",
    assistant_pattern: str | None = None,
    tokenizer=None,
) -> DataFrame:
    """Long-form raw turns → prepared rows.

    ``turns`` may be a list of sources (ids distinct across them).
    ``max_samples`` applies the early cap (``3*n`` raw conversations of each
    source in seeded order, before the tokenizer, O2) and the final cap (``n``
    rows of all, O3).

    Mask method (P15), resolved once on the driver: a custom
    ``assistant_pattern`` (X3) uses the regex path; otherwise the template
    table gives the spans by construction.  ``tokenizer`` plugs a model
    tokenizer (e.g. :class:`draftsmith.functions.text.HFTokenizer`) into the
    construction path; the default is the JVM regex tokenizer.
    """
    sources = turns if isinstance(turns, list) else [turns]
    if max_samples is not None:  # O2: raw conversations of each source
        sources = [t.join(shuffle_cap(t.select(id_col).distinct(), seed, id_col, 3 * max_samples), id_col, "left_semi") for t in sources]
    norm = normalize_turns(reduce(DataFrame.unionByName, sources), id_col=id_col, turn_dropout=turn_dropout, seed=seed)
    if assistant_pattern is not None:
        from draftsmith.operators.tokenize import min_valid_tokens, prepare_rows_by_pattern

        rows = min_valid_tokens(prepare_rows_by_pattern(norm, assistant_pattern, template, max_length, vocab_size), minimum_valid_tokens)
    else:
        rows = prepare_rows(norm, template, max_length, vocab_size, minimum_valid_tokens, tokenizer=tokenizer)
    if max_samples is not None:  # O3: the ids are ranked, the rows only filtered
        rows = rows.join(shuffle_cap(rows.select("sample_id"), seed, "sample_id", max_samples), "sample_id", "left_semi")
    return rows


def write_prepared(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """K1: existing output is kept unless ``overwrite``."""
    rows.select("sample_id", "input_ids", "loss_mask", "seq_len").write.mode("overwrite" if overwrite else "ignore").parquet(path)


def dataset_version(df: DataFrame) -> str:
    """A version key of a file-backed dataset: hash of its sorted input file list
    (metadata only — no data is read)."""
    import hashlib

    return hashlib.md5("\n".join(sorted(df.inputFiles())).encode("utf-8")).hexdigest()[:16]


def write_frequencies(freq: DataFrame, path: str, version: str | None = None) -> None:
    """K2: written only when absent (``mode('ignore')``).

    Q9: with ``version`` (e.g. :func:`dataset_version` of the prepared rows)
    the table lives under ``version=<v>``, so new data never reuses a stale
    frequency table while a rerun on the same data is still skipped.
    """
    target = path if version is None else f"{path.rstrip('/')}/version={version}"
    freq.write.mode("ignore").parquet(target)


def write_vocab_maps(d2t: DataFrame, t2d: DataFrame, path: str) -> None:
    """K3: both maps as Parquet tables."""
    d2t.write.mode("overwrite").parquet(f"{path}/d2t")
    t2d.write.mode("overwrite").parquet(f"{path}/t2d")


def resolve_vocab(
    spark: SparkSession,
    d2t_path: str | None = None,
    t2d_path: str | None = None,
    cache_dir: str | None = None,
    freq: DataFrame | None = None,
    draft_vocab_size: int | None = None,
    target_vocab_size: int = DEFAULT_VOCAB_SIZE,
) -> tuple[DataFrame, DataFrame] | None:
    """Explicit pair → cached pair → rebuild from frequencies → full vocab (None)."""
    if d2t_path and t2d_path:
        return spark.read.parquet(d2t_path), spark.read.parquet(t2d_path)
    if cache_dir:
        try:
            return spark.read.parquet(f"{cache_dir}/d2t"), spark.read.parquet(f"{cache_dir}/t2d")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # an absent cache falls through
                raise
    if freq is not None and draft_vocab_size:
        sel = select_draft_tokens(spark, freq, draft_vocab_size)
        maps = vocab_maps(sel, target_vocab_size, spark)
        if cache_dir:
            write_vocab_maps(*maps, cache_dir)
        return maps
    return None


def draft_vocabulary_job(spark: SparkSession, sf_dir: str, draft_vocab_size: int = 1024) -> DataFrame:
    """The flagship query: conversations → rows → frequencies → draft vocab.

    Returns ``d2t`` with the frequency of each selected id (0 for fill ids).
    """
    raw = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    rows = prepare_turns(raw)
    freq = combine_frequencies(token_frequency(rows))
    sel = select_draft_tokens(spark, freq, draft_vocab_size)
    d2t, _ = vocab_maps(sel, DEFAULT_VOCAB_SIZE, spark)
    return d2t.join(freq.withColumnRenamed("token_id", "target_id"), "target_id", "left").select(
        "draft_id", "target_id", "offset", F.coalesce("freq", F.lit(0)).cast("bigint").alias("freq")
    )
