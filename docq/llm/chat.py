"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered whole, encoded once with character offsets, and its
sorted turn spans are intersected with the token spans by binary search.

Template: for each turn ``<|im_start|>role\\ntext<|im_end|>\\n``.  Control
strings inside roles and texts get a backslash after their first character (one
more where some stand there already), so they can neither open nor close a
turn, and the escape is undone exactly by taking one backslash away.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Strings that some tokenizer or template takes as control.
CONTROL = (OPEN, CLOSE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


class Template:
    """Rendering, escaping and parsing for one set of control strings."""

    def __init__(self, control: tuple[str, ...] = CONTROL):
        if OPEN not in control or CLOSE not in control:
            raise ValueError("the template's own marks must be control strings")
        heads = "".join(sorted({c[0] for c in control}))
        tails = {h: "|".join(re.escape(c[1:]) for c in control if c[0] == h) for h in heads}
        self._bare = re.compile("|".join(f"{re.escape(h)}\\\\*(?={t})" for h, t in tails.items()))

    def escape(self, text: str) -> str:
        return self._bare.sub(lambda m: m[0] + "\\", text)

    def unescape(self, text: str) -> str:
        return self._bare.sub(lambda m: m[0][:-1] if len(m[0]) > 1 else m[0], text)

    def escape_role(self, role: str) -> str:
        return self.escape(role).replace("\\", "\\\\").replace("\n", "\\n")

    def unescape_role(self, role: str) -> str:
        return self.unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))

    def render(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The conversation as one string, and the span of each turn's text."""
        parts, spans, at = [], [], 0
        for role, text in turns:
            head, body = f"{OPEN}{self.escape_role(role)}\n", self.escape(text)
            spans.append((at + len(head), at + len(head) + len(body)))
            parts += [head, body, CLOSE + "\n"]
            at = spans[-1][1] + len(CLOSE) + 1
        return "".join(parts), spans

    def parse(self, rendered: str) -> list[tuple[str, str, int, int]]:
        """role, text and the span of the text, read from a rendered string."""
        out, at = [], 0
        while at < len(rendered):
            line = rendered.index("\n", at)
            end = rendered.index(CLOSE, line)
            out.append((self.unescape_role(rendered[at + len(OPEN) : line]), self.unescape(rendered[line + 1 : end]), line + 1, end))
            at = end + len(CLOSE) + 1
        return out


def token_mask(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens overlap one of the sorted, disjoint spans (n, 2)."""
    spans = spans[spans[:, 0] < spans[:, 1]] if len(spans) else spans
    if not len(spans) or not len(starts):
        return np.zeros(len(starts), dtype=bool)
    at = np.searchsorted(spans[:, 1], starts, side="right")
    inside = at < len(spans)
    return inside & (spans[np.minimum(at, len(spans) - 1), 0] < ends)


def masked_text(rendered: str, starts, ends, mask, spans) -> list[str]:
    """Text under the mask, one piece for each span that has some: the masked
    tokens' characters inside the span, each character once."""
    out = []
    for lo, hi in spans:
        a, b = np.searchsorted(ends, lo, side="right"), np.searchsorted(starts, hi, side="left")
        at, got = lo, []
        for t in range(a, b):
            if mask[t]:
                s, e = max(int(starts[t]), at), min(int(ends[t]), hi)
                if s < e:
                    got.append(rendered[s:e])
                    at = e
        if got:
            out.append("".join(got))
    return out


_tokenizers: dict = {}


def load_tokenizer(path: str):
    """A tokenizer whose control strings are ordinary text; one for each worker."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _tokenizers[path] = t
    return _tokenizers[path]


def _format(path: str, loss_roles: tuple[str, ...], control):
    def run(batches):
        tok, template = load_tokenizer(path), Template(control)
        for batch in batches:
            for i in range(batch.num_rows):
                turns = [(r or "", t or "") for r, t in zip(batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), strict=True)]
                text, spans = template.render(turns)
                enc = tok.encode(text, add_special_tokens=False)
                off = np.array(enc.offsets, dtype=np.int32).reshape(-1, 2)
                loss = np.array([s for s, (r, _) in zip(spans, turns, strict=True) if r in loss_roles], dtype=np.int32).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, 1),
                        pa.array([text]),
                        pa.array([enc.ids], pa.list_(pa.int32())),
                        pa.array([off[:, 0]], pa.list_(pa.int32())),
                        pa.array([off[:, 1]], pa.list_(pa.int32())),
                        pa.array([token_mask(off[:, 0], off[:, 1], loss)], pa.list_(pa.bool_())),
                    ],
                    names=["conv_id", "formatted", "input_ids", "token_start", "token_end", "loss_mask"],
                )

    return run


FORMATTED = "conv_id long, formatted string, input_ids array<int>, token_start array<int>, token_end array<int>, loss_mask array<boolean>"


def format_conversations(turns: DataFrame, tokenizer_path: str, loss_roles: tuple[str, ...] = ("assistant",), control: tuple[str, ...] = CONTROL) -> DataFrame:
    """One row for each conversation: formatted, input_ids, token_start,
    token_end (code points), loss_mask (tokens that overlap a text of loss_roles).

    turns: conv_id, turn, role, text; other columns are not read.  Rows are
    ordered by turn, ties and repeated rows by role, then text; a null turn
    comes first.  Null role or text is empty.  Rows with a null conv_id make one
    conversation of their own.  An empty table gives an empty result.  A
    conversation is one training text and is handled in one task.
    """
    whole = (
        turns.groupBy(F.col("conv_id").cast("long").alias("conv_id"))
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
        .select("conv_id", F.col("t.role").alias("roles"), F.col("t.text").alias("texts"))
    )
    return whole.mapInArrow(_format(tokenizer_path, loss_roles, control), FORMATTED)


def _read(loss_roles, control):
    def run(batches):
        template = Template(control)
        for batch in batches:
            out = [[], [], [], [], []]
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                turns = template.parse(text)
                starts, ends, mask = (np.array(batch.column(c)[i].as_py()) for c in (2, 3, 4))
                spans = [(s, e) for r, _, s, e in turns if r in loss_roles]
                pieces = masked_text(text, starts, ends, mask, spans)
                for col, v in zip(out, (batch.column(0)[i].as_py(), [t[0] for t in turns], [t[1] for t in turns], [template.unescape(p) for p in pieces], len(text)), strict=True):
                    col.append(v)
            kinds = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["conv_id", "roles", "texts", "loss_texts", "formatted_chars"])

    return run


def read_conversations(formatted: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), control: tuple[str, ...] = CONTROL) -> DataFrame:
    """What a formatted table says: conv_id, roles, texts, loss_texts (the text
    under the loss mask, unescaped, one entry for each turn that has some),
    formatted_chars."""
    return formatted.select("conv_id", "formatted", "token_start", "token_end", "loss_mask").mapInArrow(
        _read(loss_roles, control), "conv_id long, roles array<string>, texts array<string>, loss_texts array<string>, formatted_chars long"
    )
