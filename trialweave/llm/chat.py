"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, turn by turn in the order of ``turn`` (then role, then text):

    <s>ROLE
    TEXT</s>

``<s>``, ``</s>``, ``[INST]`` and ``[/INST]`` are control strings. Inside roles and texts a backslash is doubled and a
control string gets a backslash after its first character; a line feed in a role becomes a backslash and ``n``. So an
unescaped control string is always the template's, and unescaping gives the very text.

The rendered text is encoded once, with offsets in code points. The turns' spans and the tokens' spans are both sorted;
binary search finds the tokens that overlap the assistant turns' texts, and these tokens are under the loss mask. Where a
token reaches over a text's edge, the loss counts only its part inside. Reading back takes nothing but the formatted
text, the tokens' offsets and the mask: what the masked tokens cover of each assistant text that the text shows is the
learned text, so a token that is missing from the mask is missing there.

Defined cases: a null text or role is empty; repeated turns are all rendered; a null turn comes first; a null conv_id is
a conversation; an empty table gives no rows. Only the columns named are used. A conversation's turns are brought
together in one row, as the rendered conversation must be one text.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm._common import released

CONTROL = re.compile(r"([<\[])(/?(?:s>|INST\]))")
TURN = re.compile(r"<s>([^\n]*)\n(.*?)</s>\n", re.S)
LEARNED = "assistant"
FORMATTED = "conv_id long, formatted string, input_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"


def escape(text: str, role: bool = False) -> str:
    text = CONTROL.sub(r"\1\\\2", _shielded(text))
    return text.replace("\n", "\\n") if role else text


def _shielded(text: str) -> str:
    return text.replace("\\", "\\\\")


def unescape(text: str, role: bool = False) -> str:
    return re.sub(r"\\(\\|n)?" if role else r"\\(\\)?", lambda m: {"\\": "\\", "n": "\n", None: ""}[m[1]], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of the texts to learn."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"<s>{escape(role, True)}\n", escape(text)
        if role == LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, "</s>\n"]
        at += len(head) + len(body) + 5
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(m[1], True), unescape(m[2])) for m in TURN.finditer(formatted)]


def learned_spans(formatted: str) -> list[tuple[int, int]]:
    """Where the texts to learn stand in a formatted conversation."""
    return [m.span(2) for m in TURN.finditer(formatted) if m[1] == LEARNED]


def mask_of(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens overlap a span. Starts and ends don't fall."""
    mask = np.zeros(len(starts), bool)
    for a, b in spans:
        mask[np.searchsorted(ends, a, "right") : np.searchsorted(starts, b, "left")] = True
    return mask


def covered(text: str, starts: np.ndarray, ends: np.ndarray, a: int, b: int) -> str:
    """What tokens (in order) cover of text[a:b]."""
    i, j = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
    low, high = np.maximum(starts[i:j], a), np.maximum.accumulate(np.minimum(ends[i:j], b))
    gap = np.flatnonzero(low[1:] > high[:-1]) + 1
    cut = [0, *gap.tolist(), len(low)] if len(low) else [0]
    return "".join(text[low[x] : high[y - 1]] for x, y in zip(cut[:-1], cut[1:], strict=True))


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, processors

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    tok.post_processor = processors.ByteLevel(trim_offsets=False)
    return tok


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts or [np.zeros(0)]), kind))


def format_conversations(rows: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row a conversation: its formatted text, ids, offsets and loss mask."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t"), _by_turn).alias("turns"))
    whole = whole.select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def run(batches):
        tok = _tokenizer(tokenizer_path)
        for batch in batches:
            for i in range(0, batch.num_rows, PER_CALL):
                part = batch.slice(i, PER_CALL)
                made = [render(list(zip(r, t, strict=True))) for r, t in zip(part["roles"].to_pylist(), part["texts"].to_pylist(), strict=True)]
                ids, starts, ends, mask = [], [], [], []
                for (_, spans), e in zip(made, tok.encode_batch([x for x, _ in made], add_special_tokens=False), strict=True):
                    off = np.fromiter(chain.from_iterable(e.offsets), np.int32).reshape(-1, 2)
                    ids.append(np.array(e.ids, np.int32))
                    starts.append(off[:, 0])
                    ends.append(off[:, 1])
                    mask.append(mask_of(off[:, 0], off[:, 1], spans))
                cells = [_lists(x, pa.int32()) for x in (ids, starts, ends)]
                yield pa.record_batch([part["conv_id"], pa.array([x for x, _ in made], pa.string()), *cells, _lists(mask, pa.bool_())], names=FORMATTED_NAMES)
        released()

    return whole.mapInArrow(run, FORMATTED)


FORMATTED_NAMES = ["conv_id", "formatted", "input_ids", "token_starts", "token_ends", "loss_mask"]
PER_CALL = 200


def _by_turn(x, y):
    def cmp(name, rest):
        a, b = x[name], y[name]
        return F.when(a.isNull() & b.isNotNull(), -1).when(a.isNotNull() & b.isNull(), 1).when(a < b, -1).when(a > b, 1).otherwise(rest)

    return cmp("turn", cmp("role", cmp("text", F.lit(0))))


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted rows say: turns parsed from the text, learned text from the mask's tokens and their offsets."""

    def run(batches):
        for batch in batches:
            out = []
            offsets = batch["loss_mask"].offsets.to_numpy().tolist()
            first = offsets[0] if offsets else 0
            starts, ends = (batch[c].flatten().to_numpy() for c in ("token_starts", "token_ends"))
            mask = batch["loss_mask"].flatten().to_numpy(zero_copy_only=False)
            for text, i, j in zip(batch["formatted"].to_pylist(), offsets[:-1], offsets[1:], strict=True):
                on = mask[i - first : j - first]
                low, high = starts[i - first : j - first][on], ends[i - first : j - first][on]
                turns = parse(text)
                learned = [unescape(covered(text, low, high, a, b)) for a, b in learned_spans(text)]
                out.append((len(turns), sha(f"{r}\n{t}\n" for r, t in turns), sum(map(len, learned)), sha(learned), len(text), j - i, int(on.sum())))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_loss_tokens"]
            yield pa.record_batch([batch["conv_id"], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)
        released()

    return formatted.mapInArrow(run, DIGEST)


def sha(parts) -> str:
    h = hashlib.sha256()
    for p in parts:
        h.update(p.encode())
    return h.hexdigest()
