"""Chat formatting by a declarative template and a finite-state machine over roles.

The template gives each role its marks and says whether its text is trained on;
the machine says which role may follow which. Conversations stream through
tasks in order, turn by turn: none is held as a whole, however long it is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """marks: prefix and suffix of each role; learned: roles whose text is under the loss mask.

    follows: by state, the roles that may come next, each being the next state;
    ends: states in which a conversation may stop. Roles without marks are
    written between ``other`` marks with their name.
    """

    marks: dict[str, tuple[str, str]]
    learned: frozenset[str]
    follows: dict[str, frozenset[str]]
    ends: frozenset[str]
    controls: tuple[str, ...]
    other: tuple[str, str, str] = ("[ROLE] ", " [TEXT] ", " [/ROLE]")
    pattern: re.Pattern = field(init=False)

    def __post_init__(self) -> None:
        longest_first = sorted(self.controls, key=len, reverse=True)
        object.__setattr__(self, "pattern", re.compile("|".join(map(re.escape, longest_first)) + "|" + re.escape(ESCAPE)))

    def escape(self, text: str) -> str:
        """Escape marks doubled, and one put after the first character of every control string."""
        return self.pattern.sub(lambda m: ESCAPE * 2 if m[0] == ESCAPE else m[0][0] + ESCAPE + m[0][1:], text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """Marks and escaped text of a turn, each with its loss flag."""
        if role in self.marks:
            before, after = self.marks[role]
        else:
            before, after = self.other[0] + self.escape(role) + self.other[1], self.other[2]
        return [(before, False), (self.escape(text), role in self.learned), (after, False)]

    def parse(self, turn: str) -> tuple[str, str]:
        """Role and text of a formatted turn."""
        for role, (before, after) in self.marks.items():
            if turn.startswith(before) and turn.endswith(after):
                return role, self.unescape(turn[len(before):len(turn) - len(after)])
        opening, middle, closing = self.other
        if not (turn.startswith(opening) and turn.endswith(closing)):
            raise ValueError("a turn begins with no role's mark")
        role, text = turn[len(opening):len(turn) - len(closing)].split(middle, 1)
        return self.unescape(role), self.unescape(text)


#: Marks of an instruction format.
INSTRUCT = Template(
    marks={"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("<s>[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")},
    learned=frozenset({"assistant"}),
    follows={
        "start": frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}),
        "assistant": frozenset({"user"}),
    },
    ends=frozenset({"assistant"}),
    controls=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[TEXT]", "[/ROLE]"),
)

TURNS = "conv string, turn_no long, segments array<struct<text: string, loss: boolean>>, state string, allowed boolean"
DIGESTS = ("conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
           "valid boolean, fault_turn long")


def format_turns(conversations: DataFrame, template: Template = INSTRUCT, id_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per turn (``TURNS``): its segments with loss flags, the state it leads to and whether the machine allows it.

    Turns follow ``turn``, then role and text where turns tie; a null turn comes
    first. Null roles and texts count as empty; a role that the template doesn't
    know keeps its name between marks, and is never allowed. Repeated rows are
    turns of their own. Rows with a null id form one conversation. conv is the id
    as a string. The rows of a conversation lie in one partition, in order.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv: object = run  # no conversation yet
        state, number = "start", 0
        for batch in batches:
            out = []
            for key, role, text in zip(batch.conv, batch.role, batch.text, strict=True):
                if key != conv:
                    conv, state, number = key, "start", 0
                allowed = role in template.follows.get(state, ())
                state = role if role in template.follows else state
                out.append((key, number, [{"text": t, "loss": f} for t, f in template.segments(role, text)], state, allowed))
                number += 1
            yield pd.DataFrame(out, columns=["conv", "turn_no", "segments", "state", "allowed"])

    rows = conversations.select(
        F.col(id_col).cast("string").alias("conv"), F.col(turn_col).alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))])
    ordered = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    return ordered.mapInPandas(run, TURNS)


def read_turns(formatted: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """A row per conversation (``DIGESTS``), read back from the formatted turns.

    Takes the frame of ``format_turns``, or one read from storage and put in
    order again. turns_sha256 covers role, line feed, text and line feed of each
    turn; the loss digest covers the unescaped text under the mask. valid says
    that the machine allowed every turn and may stop in the last state;
    fault_turn is the first turn that it did not allow, else null.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv: object = run
        turns = learned = None
        n = loss_chars = chars = 0
        state, fault = "start", None

        def row() -> tuple:
            return (conv, n, turns.hexdigest(), loss_chars, learned.hexdigest(), chars, fault is None and state in template.ends, fault)

        for batch in batches:
            out = []
            for key, number, segments, after, allowed in zip(
                    batch.conv, batch.turn_no, batch.segments, batch.state, batch.allowed, strict=True):
                if key != conv:
                    if turns:
                        out.append(row())
                    conv, turns, learned = key, hashlib.sha256(), hashlib.sha256()
                    n = loss_chars = chars = 0
                    fault = None
                whole = "".join(s["text"] for s in segments)
                role, text = template.parse(whole)
                turns.update(f"{role}\n{text}\n".encode())
                under = template.unescape("".join(s["text"] for s in segments if s["loss"]))
                learned.update(under.encode())
                n, loss_chars, chars, state = n + 1, loss_chars + len(under), chars + len(whole), after
                fault = number if fault is None and not allowed else fault
            if out:
                yield frame(out)
        if turns:
            yield frame([row()])

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in DIGESTS.split(", ")])
        return out.assign(fault_turn=out.fault_turn.astype("Int64"))

    return formatted.mapInPandas(run, DIGESTS)


def expected_sql(added: str) -> str:
    """DuckDB SQL for ``read_turns`` over ``conversations`` and the rows of ``added``."""
    escaped = "replace(text, '\\', '\\\\')"
    for control in sorted(INSTRUCT.controls, key=len, reverse=True):
        escaped = f"replace({escaped}, '{control}', '{control[0]}\\{control[1:]}')"
    marks = " ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b) in INSTRUCT.marks.items())
    return f"""
    WITH turns AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
      FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL {added})),
    parts AS (SELECT *, {escaped} AS escaped FROM turns)
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
      sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
      sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
      sum(length(escaped) + CASE role {marks} END)::BIGINT AS formatted_chars
    FROM parts GROUP BY conv_id
    """
