"""Chat formatting: records of many layouts become turns, turns become one marked text.

A record is a JSON object. Its fingerprint is the hash of the sorted nested paths it fills, of
those paths that any known layout has; other fields do not count. Fingerprints select a
declarative layout, which says where the turns are: texts at a path, with the role they have,
or lists of turns. The template marks turns and escapes its own control strings inside texts
and roles, so a text can neither end a turn nor begin one, and reading back gives what was
written. Everything is column expressions.

A null or empty field is not filled; a list is if any of its items fills the path. A record that
is null, broken, or of no known layout has layout null and no segments. A turn without a text
has an empty one, a turn without a role the role ''.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

# Where the turns of each layout are, in order. "role: path" is a text with a fixed role,
# "role: path + path" joins two by a blank line, "path[] role text" is a list of turns with
# the fields of their role and text; a path in parentheses may be missing.
LAYOUTS = {
    "messages": ["(system: system)", "messages[] role content"],
    "turns": ["turns[] role text"],
    "conversations": ["(system: system)", "conversations[] from value"],
    "dialogue": ["dialogue[] speaker utterance"],
    "prompt_completion": ["(system: system)", "user: prompt", "assistant: completion"],
    "prompt_response": ["(system: system)", "user: prompt", "assistant: response"],
    "instruction_output": ["(system: system)", "user: instruction + (input)", "assistant: output"],
    "instruction_response": ["(system: system)", "user: instruction + (context)", "assistant: response"],
    "question_answer": ["(system: system)", "user: question", "assistant: answer"],
    "query_reply": ["(system: system)", "user: query", "assistant: reply"],
}
# Names that other layouts use for the same roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

START, END = "<|im_start|>", "<|im_end|>"
LOSS = "assistant"


def _parts(layout: list[str]) -> list[tuple[str | None, list[str]]]:
    """(role, paths) of texts and (None, [list, role, text]) of lists."""
    out = []
    for line in layout:
        role, colon, paths = line.replace("(", "").replace(")", "").partition(": ")
        if colon:
            out.append((role, paths.split(" + ")))
        else:
            out.append((None, line.replace("[]", "").split(" ")))
    return out


def _paths(layout: list[str]) -> tuple[set[str], set[str]]:
    """Paths that a record of the layout fills, and those that it may."""
    must, may = set(), set()
    for line, (role, names) in zip(layout, _parts(layout)):
        if role is None:
            must |= {f"{names[0]}[].{name}" for name in names[1:]}
        else:
            for name in names:
                (may if line.startswith("(") or f"({name})" in line else must).add(name)
    return must, may


def _lists() -> dict[str, list[str]]:
    return {names[0]: names[1:] for layout in LAYOUTS.values() for role, names in _parts(layout) if role is None}


def _texts() -> list[str]:
    return sorted({name for layout in LAYOUTS.values() for role, names in _parts(layout) if role for name in names})


def parsed(record: Column) -> Column:
    """The known fields of a JSON object, null where missing or of another kind."""
    fields = [f"`{name}` string" for name in _texts()]
    fields += [f"`{name}` array<struct<{', '.join(f'`{f}`: string' for f in inner)}>>" for name, inner in _lists().items()]
    return F.from_json(record, ", ".join(fields), {"maxStringLen": str((1 << 31) - 1)})


def _filled(items: Column, name: str, field: str) -> Column:
    return F.when(F.exists(items, lambda item: item[field].isNotNull()), F.lit(f"{name}[].{field}"))


def fingerprint(fields: Column) -> Column:
    """Hash of the nested paths that ``fields``, made by ``parsed``, fills."""
    filled = [F.when(fields[name] != "", F.lit(name)) for name in _texts()]
    filled += [_filled(fields[name], name, f) for name, inner in _lists().items() for f in inner]
    return F.xxhash64(F.array_join(F.array_sort(F.array_compact(F.array(*filled))), "\n"))


def layout_of(mark: Column) -> Column:
    """Name of the layout whose paths have this fingerprint; null if none has."""
    found = None
    for name, layout in LAYOUTS.items():
        must, may = _paths(layout)
        for n in range(len(may) + 1):
            for some in combinations(sorted(may), n):
                known = mark == F.xxhash64(F.lit("\n".join(sorted(must | set(some)))))
                found = F.when(known, F.lit(name)) if found is None else found.when(known, F.lit(name))
    return found


def _role(name: Column) -> Column:
    out = None
    for other, role in ROLES.items():
        out = F.when(name == other, F.lit(role)) if out is None else out.when(name == other, F.lit(role))
    return F.coalesce(out.otherwise(name), F.lit(""))


def turns(fields: Column, layout: Column) -> Column:
    """Turns (role, text) of a record, by the layout found for it."""
    def made(part: tuple[str | None, list[str]]) -> Column:
        role, names = part
        if role is None:
            return F.coalesce(F.transform(fields[names[0]], lambda item: F.struct(
                _role(item[names[1]]).alias("role"), F.coalesce(item[names[2]], F.lit("")).alias("text"))), F.array())
        whole = F.concat_ws("\n\n", *(F.when(fields[name] != "", fields[name]) for name in names))
        return F.when(whole != "", F.array(F.struct(F.lit(role).alias("role"), whole.alias("text")))).otherwise(F.array())

    out = None
    for name, lines in LAYOUTS.items():
        every = F.concat(*map(made, _parts(lines)))
        out = F.when(layout == name, every) if out is None else out.when(layout == name, every)
    return out


def escaped(text: Column) -> Column:
    """One bar more in each run of bars that follows a ``<``: no control string is left."""
    return F.regexp_replace(text, r"<(\|+)", "<$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\|+)\|", "<$1")


def _one_line(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def _many_lines(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def segments(turns: Column, loss: str = LOSS) -> Column:
    """The marked text of the turns, cut where the loss mask begins or ends: (text, loss). The
    texts of the role ``loss`` are under the mask, the marks around them are not."""
    def one(text: Column, masked: bool) -> Column:
        return F.struct(text.alias("text"), F.lit(masked).alias("loss"))

    def made(turn: Column) -> Column:
        head = F.concat(F.lit(START), _one_line(turn["role"]), F.lit("\n"))
        text, tail = escaped(turn["text"]), F.lit(f"{END}\n")
        return F.when(turn["role"] == loss, F.array(one(head, False), one(text, True), one(tail, False))).otherwise(
            F.array(one(F.concat(head, text, tail), False)))

    return F.flatten(F.transform(turns, made))


def whole(segments: Column) -> Column:
    """The marked text: all segments one after another."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_turns(formatted: Column) -> Column:
    """Turns (role, text) of a marked text, as they were before it was made."""
    parts = F.split(formatted, r"<\|im_end\|>\n", -1)

    def one(part: Column) -> Column:
        head = F.substring_index(part, "\n", 1)
        return F.struct(_many_lines(F.substr(head, F.lit(len(START) + 1))).alias("role"),
                        unescaped(F.substr(part, F.length(head) + 2)).alias("text"))

    return F.transform(F.slice(parts, 1, F.size(parts) - 1), one)


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, as it was before it was escaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def format_records(records: DataFrame, record: str = "record", loss: str = LOSS,
                   into: tuple[str, str, str] = ("fingerprint", "layout", "segments")) -> DataFrame:
    """``records`` with the column ``record`` replaced by the fingerprint of its paths, the
    layout this selects, and the segments of its marked text. Each row is handled alone, so
    repeated rows get equal answers; other columns pass through, and those named as ``into``
    are replaced."""
    rest = [c for c in records.columns if c != record and c.lower() not in into]
    fields, mark, layout = fresh(records.select(*rest), "_fields", "_mark", "_layout")
    known = records.select(*rest, parsed(F.col(record)).alias(fields))
    known = known.withColumn(mark, fingerprint(F.col(fields))).withColumn(layout, layout_of(F.col(mark)))
    return known.select(*rest, F.col(mark).alias(into[0]), F.col(layout).alias(into[1]),
                        segments(turns(F.col(fields), F.col(layout)), loss).alias(into[2]))


def gathered(rows: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text",
             into: str = "record") -> DataFrame:
    """(key, into): rows of one turn each as one record per key, of layout ``turns``. Ties of
    ``order`` go by role and text. One record is one row, however many turns it has."""
    filled = rows.select(F.col(key).alias("key"), F.col(order).alias("at"), F.coalesce(role, F.lit("")).alias("role"),
                         F.coalesce(text, F.lit("")).alias("text"))
    all_turns = F.transform(F.sort_array(F.collect_list(F.struct("at", "role", "text"))),
                            lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return filled.groupBy("key").agg(F.to_json(F.struct(all_turns.alias("turns"))).alias(into)).withColumnRenamed("key", key)
