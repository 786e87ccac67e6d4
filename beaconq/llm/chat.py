"""Chat formatting by incremental rendering of a black-box template.

Method: successive prefixes of a conversation are rendered; where the longer output
begins with the shorter one, what it adds is the new turn's span, and where it does
not, the template rewrites history and is reported. A turn's content inside its span
is found by rendering the turn once more with a sentinel for its text.

The template is any function from a list of (role, text) to a string. Conversations
are streamed turn by turn, and each prefix is rendered from its first turn. Only for a
template declared ``concatenative`` (a turn's output depends on nothing but the turn)
are no more than the latest ``CONTEXT`` turns at least rendered with each new one once
there are twice as many, so that memory and time per turn are bounded; for others both
grow with the conversation. The declaration is verified: after every doubling of its
turns, and at its end, the whole conversation of up to ``HISTORY`` turns is rendered from
its first turn and compared with the pieces by digest; a template that is not what it is
declared to be fails the job.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, table

Template = Callable[[list[tuple[str, str]]], str]
#: From what a turn added, the content's place in it, and the role as given, to role and text.
Reader = Callable[[str, int, int, str], tuple[str, str]]
CONTEXT = 32
#: Turns of a conversation that are kept to verify a declared template with.
HISTORY = 4096
#: Private-use characters; one that is not in the role stands for the text while its place is found.
SENTINELS = "\ue000\ue001\ue002\ue003"
BEGIN, END = "<|turn|>", "<|done|>"
#: Control strings of this template and of common others, never left bare in a text.
CONTROL = [BEGIN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
CONTROL_START = re.compile(r"(?=" + "|".join(map(re.escape, CONTROL)) + r")(.)", re.DOTALL)
ROLE_LINE = re.compile(re.escape(BEGIN) + r"((?:\\.|[^\\\n])*)\n", re.DOTALL)
TURNS = (
    "conv_id long, nth long, role string, piece string, content_start long, content_end long, in_loss boolean, rewrites_history boolean"
)
DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long,"
    " rewrites_history boolean"
)


def escape(text: str) -> str:
    """Double backslashes, and put one after the first character of a control string."""
    return CONTROL_START.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def marked_turns(turns: list[tuple[str, str]]) -> str:
    """The template: each turn between marks, its role on the first line."""
    return "".join(f"{BEGIN}{escape(role).replace(chr(10), chr(92) + chr(10))}\n{escape(text)}{END}\n" for role, text in turns)


def read_marked(piece: str, start: int, end: int, role: str) -> tuple[str, str]:
    """Role and text of a turn, from the output of ``marked_turns`` alone."""
    return unescape(ROLE_LINE.match(piece)[1]), unescape(piece[start:end])


def read_span(piece: str, start: int, end: int, role: str) -> tuple[str, str]:
    """For any other template: the role as given, and the content as it stands in the output."""
    return role, piece[start:end]


marked_turns.concatenative, marked_turns.read = True, read_marked


class Renderer:
    """Feeds turns of one conversation to a template and locates what each adds."""

    def __init__(self, template: Template, context: int | None = None) -> None:
        """``context``: turns kept of long conversations, for concatenative templates only."""
        self.template, self.context = template, context
        self.turns: list[tuple[str, str]] = []
        self.history: list[tuple[str, str]] | None = []
        self.written = hashlib.sha256()
        self.out = template([])
        self._write(self.out)

    def _write(self, piece: str) -> None:
        self.written.update(piece.encode("utf-8", "surrogatepass"))

    def verify(self) -> None:
        """Compare the whole output with the pieces, if the latest turns alone were rendered."""
        if self.context and self.history and len(self.history) > len(self.turns):
            whole = self.template(self.history).encode("utf-8", "surrogatepass")
            if hashlib.sha256(whole).digest() != self.written.digest():
                raise ValueError("the template is declared concatenative, but a turn's output depends on others")

    def add(self, role: str, text: str) -> tuple[str, int, int, bool]:
        """The piece that the turn adds, where in it the content lies, and whether
        the template changed what it had written before. Then the piece starts where
        the outputs part, and the content is the whole piece."""
        if self.context:
            if self.history is not None:
                n = len(self.history)
                if n & (n - 1) == 0 or n == HISTORY:
                    self.verify()
                if n == HISTORY:
                    self.history = None
                else:
                    self.history.append((role, text))
            if len(self.turns) >= 2 * self.context:
                del self.turns[: -self.context]
                self.out = self.template(self.turns)
        before, self.turns = self.out, [*self.turns, (role, text)]
        self.out = self.template(self.turns)
        self._write(self.out[len(before) :])
        if not self.out.startswith(before):
            same = next((i for i, (a, b) in enumerate(zip(before, self.out)) if a != b), min(len(before), len(self.out)))
            return self.out[same:], 0, len(self.out) - same, True
        sentinel = next((c for c in SENTINELS if c not in role), SENTINELS)
        probe = self.template([*self.turns[:-1], (role, sentinel)])
        at = probe.find(sentinel, len(before))
        piece = self.out[len(before) :]
        if at < 0:
            return piece, 0, len(piece), False
        after = len(probe) - at - len(sentinel)
        return piece, at - len(before), len(piece) - after, False


def format_turns(conversations: DataFrame, template: Template = marked_turns, learned_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each turn, in order within its conversation: the text that it adds
    to the output, the content's place in that, and whether it is under the loss mask,
    by its role as read from the output where the template has a ``read``.

    Turns are ordered by ``turn`` (null first), then role and text, so ties and
    repeated rows have a set order. A null text is empty, a null role ``user``. Rows
    with a null ``conv_id`` form one conversation. Conversations of any length are
    streamed; an empty table gives no rows; other columns are not read.
    """
    context = CONTEXT if getattr(template, "concatenative", False) else None
    read = getattr(template, "read", read_span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        conv, renderer, nth = object(), None, 0
        for batch in batches:
            rows, ids = [], batch["conv_id"]
            for c, role, text in zip(ids.to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist()):
                if renderer is None or c != conv:
                    if renderer:
                        renderer.verify()
                    conv, renderer, nth = c, Renderer(template, context), 0
                piece, start, end, rewrote = renderer.add(role, text)
                rows.append((c, nth, role, piece, start, end, read(piece, start, end, role)[0] in learned_roles, rewrote))
                nth += 1
            yield named(rows, TURNS)
        if renderer:
            renderer.verify()

    rows = conversations.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    together = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return map_batches(together.select("conv_id", "role", "text"), run, TURNS)


def named(rows: list[tuple], schema: str) -> dict:
    """Rows as columns by the names of the schema."""
    names = [c.split()[0] for c in schema.split(", ")]
    return dict(zip(names, map(list, zip(*rows)) if rows else [[] for _ in names]))


class Digest:
    """Reads turns of one conversation back from what was formatted."""

    def __init__(self, read: Reader) -> None:
        self.read, self.turns, self.loss = read, hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0
        self.rewrote = False

    def add(self, role: str, piece: str, start: int, end: int, in_loss: bool, rewrote: bool) -> None:
        self.n += 1
        self.chars += len(piece)
        self.rewrote |= rewrote
        role, text = self.read(piece, start, end, role)
        self.turns.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
        if in_loss:
            self.loss.update(text.encode("utf-8", "replace"))
            self.loss_chars += len(text)

    def row(self, conv) -> tuple:
        return conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.rewrote


def digests(turns: DataFrame, template: Template = marked_turns) -> DataFrame:
    """Digests of each conversation of ``format_turns`` output, streamed in its order.

    Of a template without a ``read``, the content is digested as it stands in the output,
    under the role as given. Where a turn rewrote history, that is what it wrote anew.
    """
    read = getattr(template, "read", read_span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        conv, digest = None, None
        for batch in batches:
            rows = []
            columns = ["conv_id", "nth", "role", "piece", "content_start", "content_end", "in_loss", "rewrites_history"]
            for c, nth, *rest in zip(*(batch[k].to_pylist() for k in columns)):
                if nth == 0:
                    if digest:
                        rows.append(digest.row(conv))
                    conv, digest = c, Digest(read)
                digest.add(*rest)
            yield named(rows, DIGESTS)
        if digest:
            yield named([digest.row(conv)], DIGESTS)

    return map_batches(turns, run, DIGESTS)


def op9_chat(spark, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(format_turns(given.unionByName(own)))
