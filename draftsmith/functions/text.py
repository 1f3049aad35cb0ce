"""Column-level text helpers: default regex tokenizer, token ids, chat template.

The default tokenizer is a regex tokenizer that runs inside the JVM
(``regexp_extract_all``), so it stays in whole-stage codegen and needs no
Python worker.  A real model tokenizer can be plugged in with
``draftsmith.operators.tokenize.arrow_tokenizer`` (an Arrow batch UDF).
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from draftsmith.functions.hashing import md5_int

# Fixed values of the default tokenizer.  ASCII classes only, because Java
# regex and RE2 (the DuckDB oracle) differ on ``\w`` for non-ASCII text.
# A "piece" is an alphanumeric run, one other non-space character or a run
# of spaces; pieces tile the text exactly.  Space runs are not tokens.
PIECE_PATTERN = r"[A-Za-z0-9]+|[^A-Za-z0-9 \t\r\n]|[ \t\r\n]+"
TOKEN_PATTERN = r"[A-Za-z0-9]+|[^A-Za-z0-9 \t\r\n]"
DEFAULT_VOCAB_SIZE = 131072


def text_pieces(text: Column) -> Column:
    """All pieces, spaces included (their lengths sum to ``length(text)``)."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE_PATTERN), 0)


def text_tokens(text: Column) -> Column:
    """Token strings (pieces without the space runs)."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN_PATTERN), 0)


def token_id(tok: Column, vocab_size: int = DEFAULT_VOCAB_SIZE) -> Column:
    """Hashing vocabulary: ``md5_int(token) mod vocab_size``."""
    return F.pmod(md5_int(tok), F.lit(vocab_size)).cast("bigint")


def token_ids(text: Column, vocab_size: int = DEFAULT_VOCAB_SIZE) -> Column:
    return F.transform(text_tokens(text), lambda t: token_id(t, vocab_size))


def py_token_ids(text: str, vocab_size: int = DEFAULT_VOCAB_SIZE) -> list[int]:
    """Driver-side twin of :func:`token_ids`, used for template constants only."""
    out = []
    for tok in re.findall(TOKEN_PATTERN, text):
        out.append(int(hashlib.md5(tok.encode("utf-8")).hexdigest()[:8], 16) % vocab_size)
    return out


def sql_token_ids(text_expr: str, vocab_size: int = DEFAULT_VOCAB_SIZE) -> str:
    """DuckDB twin of :func:`token_ids`."""
    return (
        f"list_transform(regexp_extract_all(coalesce({text_expr}, ''), '{TOKEN_PATTERN}'), "
        f"lambda t: (('0x' || substr(md5(t), 1, 8))::BIGINT % {vocab_size}))"
    )


@dataclass(frozen=True)
class ChatTemplate:
    """A chat template as a table ``role -> (prefix, suffix)``.

    Rendering a conversation is ``concat(prefix(role), text, suffix(role))``
    over turns in order.  The assistant *content* is the trainable span; the
    markers around it are not (the span excludes prefix and suffix).

    Both markers must start and end on a non-alphanumeric character.  Then
    tokenizing each piece on its own gives exactly the tokens of the whole
    rendered text, and token spans are known by construction (no offsets,
    no interval join, no regex over the rendered text).
    """

    roles: dict[str, tuple[str, str]] = field(default_factory=dict)
    name: str = "custom"

    def __post_init__(self):
        for role, (pre, suf) in self.roles.items():
            for piece in (pre, suf):
                if piece and (piece[0].isalnum() or piece[-1].isalnum()):
                    raise ValueError(
                        f"template marker {piece!r} of role {role!r} must start and end "
                        "with a non-alphanumeric character"
                    )

    def prefix(self, role: Column) -> Column:
        return _lookup(role, {r: p for r, (p, _) in self.roles.items()})

    def suffix(self, role: Column) -> Column:
        return _lookup(role, {r: s for r, (_, s) in self.roles.items()})

    def prefix_ids(self, role: Column, vocab_size: int = DEFAULT_VOCAB_SIZE) -> Column:
        return _lookup_ids(role, {r: py_token_ids(p, vocab_size) for r, (p, _) in self.roles.items()})

    def suffix_ids(self, role: Column, vocab_size: int = DEFAULT_VOCAB_SIZE) -> Column:
        return _lookup_ids(role, {r: py_token_ids(s, vocab_size) for r, (_, s) in self.roles.items()})

    def assistant_pattern(self) -> str:
        """Java regex whose group 1 is the assistant content."""
        pre, suf = self.roles["assistant"]
        return re.escape(pre) + r"(.*?)" + re.escape(suf)


def _lookup(role: Column, table: dict[str, str]) -> Column:
    expr = None
    for k, v in table.items():
        expr = (F.when(role == k, F.lit(v)) if expr is None else expr.when(role == k, F.lit(v)))
    return expr.otherwise(F.lit(""))


def _lookup_ids(role: Column, table: dict[str, list[int]]) -> Column:
    empty = F.array().cast("array<bigint>")
    expr = None
    for k, ids in table.items():
        arr = F.array(*[F.lit(i).cast("bigint") for i in ids]) if ids else empty
        expr = F.when(role == k, arr) if expr is None else expr.when(role == k, arr)
    return expr.otherwise(empty)


# The default template is the public ChatML layout.
CHATML = ChatTemplate(
    name="chatml",
    roles={
        "system": ("<|im_start|>system\n", "<|im_end|>\n"),
        "user": ("<|im_start|>user\n", "<|im_end|>\n"),
        "assistant": ("<|im_start|>assistant\n", "<|im_end|>\n"),
        "tool": ("<|im_start|>tool\n", "<|im_end|>\n"),
    },
)


def sanitize_name(col: Column) -> Column:
    """File-name sanitising (P27): unsafe characters and spaces become ``_``,
    then leading/trailing ``.`` and ``_`` are stripped."""
    # The characters replaced by "_".
    unsafe = r'[/\\:*?"<>| ]'
    replaced = F.regexp_replace(col, unsafe, "_")
    return F.regexp_replace(replaced, r"^[._]+|[._]+$", "")


class HFTokenizer:
    """A ``tokenizers`` tokenizer usable inside Spark tasks.

    It carries the tokenizer's JSON (so it pickles by value) and builds the
    tokenizer lazily, once per Python worker; ``encode_batch`` is what
    :func:`draftsmith.operators.tokenize.tokenize_turns` calls per Arrow batch.
    """

    def __init__(self, tokenizer_json: str, add_special_tokens: bool = False):
        self.tokenizer_json = tokenizer_json
        self.add_special_tokens = add_special_tokens
        self._tok = None
        self._sizes = None

    @classmethod
    def from_file(cls, path: str, **kw) -> "HFTokenizer":
        with open(path, encoding="utf-8") as f:
            return cls(f.read(), **kw)

    def __getstate__(self):
        return {"tokenizer_json": self.tokenizer_json, "add_special_tokens": self.add_special_tokens, "_tok": None, "_sizes": None}

    def _load(self) -> None:
        if self._tok is None:
            from tokenizers import Tokenizer

            self._tok = Tokenizer.from_str(self.tokenizer_json)

    def encode_bytes(self, text: str):
        """Ids of one text and the number of its bytes that each token stands for.
        In a byte-level vocabulary every byte of a token is written as one
        character; added tokens stand for their own text."""
        import numpy as np

        self._load()
        if self._sizes is None:
            added = {t.content for t in self._tok.get_added_tokens_decoder().values()}
            vocab = self._tok.get_vocab(with_added_tokens=True)
            self._sizes = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
            for token, i in vocab.items():
                self._sizes[i] = len(token.encode()) if token in added else len(token)
        ids = self._tok.encode(text, add_special_tokens=self.add_special_tokens).ids
        return ids, self._sizes[ids] if ids else np.zeros(0, dtype=np.int64)

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        self._load()
        return [e.ids for e in self._tok.encode_batch(list(texts), add_special_tokens=self.add_special_tokens)]
