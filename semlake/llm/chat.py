"""Chat formatting: a hidden Markov model parses transcripts into turns, which are then rendered.

Every text is split into lines. States are a role and whether a line begins what
that role says or goes on with it; observations are a line's boundary (a
speaker marker, or that a row begins there), length, opening and ending.
Probabilities are counted over all rows of a known role; what markers mean is
known beforehand and makes half of the boundary's probabilities, so that a
corpus without markers does not unlearn them. Viterbi decides the lines of a
conversation together, and the runs of one role within a row become turns.

Conversations may have any length: one is cut into stretches of whole rows, each
stretch is reduced to the best score from each state before it to each state at
its end, and these small matrices are multiplied first within a partition
and then across partitions. Top down, the best path then fixes the states
between partitions, between stretches, and within each stretch. That is exact,
and no task holds more than a stretch, a partition's matrices, or one
matrix of each partition.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import col, map_texts, table, written

STATES = ("system", "user", "assistant")
#: A role begins to speak, or goes on.
LINE_STATES = tuple((role, inside) for role in STATES for inside in (False, True))
#: Lines of a stretch at most, unless one row has more.
STRETCH = 4096
# What a speaker is called at the start of a line.
MARKERS = {
    "system": r"^\s*(?:#+\s*)?(?:system|instructions?)\s*[:>]\s*",
    "user": r"^\s*(?:#+\s*)?(?:user|human|you|question|q)\s*[:>]\s*",
    "assistant": r"^\s*(?:#+\s*)?(?:assistant|bot|ai|answer|a)\s*[:>]\s*",
}
#: A line's features and how many values each has. Boundary: nothing, a row begins, or the marker of a role.
FEATURES = {"boundary": 2 + len(STATES), "length": 15, "opening": 4, "ending": 4}
#: Of the boundary's probabilities, the share that is known beforehand; lines that what is usual counts for in each state.
KNOWN, FEW = 0.5, 5
#: The share of a feature's probabilities that is what is usual, so that no state has unheard-of lines to itself.
USUAL = 0.1
#: How often a marker stands where its role does not begin.
MISTAKEN = 1e-6
_OPEN, _END = "<|{}|>\n", "\n<|end|>\n"


def observe(text: Column) -> Column:
    """An integer for each line of the text: its features, packed."""

    def one(line: Column, i: Column) -> Column:
        boundary = F.when(i == 0, 1).otherwise(0)
        for k, role in enumerate(STATES):
            boundary = F.when(line.rlike("(?i)" + MARKERS[role]), 2 + k).otherwise(boundary)
        n = F.length(line)
        length = F.when(n == 0, 0).otherwise(F.least(F.floor(F.log2(n + 1)), F.lit(14)))
        opening = F.when(line.rlike(r"^[a-zß-ÿ]"), 1).when(line.rlike(r"^\s*(?:[-*+>#|]|\d+[.)])"), 2).when(line.rlike(r"^\s"), 3).otherwise(0)
        ending = F.when(line.rlike(r"\?\s*$"), 1).when(line.rlike(r"[.!]\s*$"), 2).when(line.rlike(r"[:;,]\s*$"), 3).otherwise(0)
        out = F.lit(0)
        for c, size in zip((boundary, length, opening, ending), FEATURES.values()):
            out = out * size + c
        return out.cast("int")

    return F.transform(F.split(text, "\n", -1), one)


def unpacked(codes) -> dict:
    """The features of packed integers, as arrays."""
    import numpy as np

    codes, out = np.asarray(codes, np.int64), {}
    for name, size in reversed(FEATURES.items()):
        out[name] = codes % size
        codes = codes // size
    return out


def ordered(turns: DataFrame, conv_col: str, order_col: str, text_col: str, role_col: str | None, stretch: int = STRETCH) -> DataFrame:
    """(conv, turn, text, role, lines, stretch, lead, i, before), written: rows in order, cut into stretches.

    The order is by conversation, turn (nulls first) and a hash of the text; a range partitioning
    keeps a conversation of any length spread over tasks. ``lead`` is the first stretch of the
    conversation in its partition; ``before`` is the state (packed, -1: unknown role, -2: a conversation
    or partition begins) of the line before the row.
    """
    text = F.coalesce(col(text_col), F.lit(""))
    role = (col(role_col) if role_col else F.lit(None)).cast("string")
    known = F.lit(-1)
    for k, r in enumerate(STATES):
        known = F.when(role == r, k).otherwise(known)
    rows = turns.select(col(conv_col).alias("conv"), col(order_col).alias("turn"), text.alias("text"), known.cast("int").alias("role"), observe(text).alias("lines"))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("copy", F.monotonically_increasing_id())
    by = ["conv", "turn", "tie", "copy"]
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("tie", "copy")
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def number(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 40
        count, lead, i, held, last, state, begun = -1, 0, 0, 0, None, -2, False
        for batch in batches:
            made = []
            sizes = pc.list_value_length(batch.column(4)).to_pylist()
            for conv, role, n in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), sizes):
                new = not begun or conv != last
                if new or held + n > stretch:
                    count, i, held = count + 1, 0, 0
                if new:
                    lead, last, state, begun = part | count, conv, -2, True
                made.append((part | count, lead, i, state))
                i, held, state = i + 1, held + n, -1 if role < 0 else 2 * role + (n > 1)
            extra = [pa.array([m[k] for m in made], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "stretch", "lead", "i", "before"])

    return written(map_texts(rows, number, shape + ", stretch long, lead long, i int, before int"), "turns", "zstd")


def learn(rows: DataFrame) -> dict:
    """Log probabilities {start, step, emit} counted over the lines of rows whose role is known.

    What comes to the driver is bounded by the states and the features' values.
    """
    import numpy as np

    known = rows.where(F.col("role") >= 0)
    states = len(LINE_STATES)
    each = known.select("role", F.posexplode("lines").alias("at", "code")).groupBy((F.col("role") * 2 + (F.col("at") > 0).cast("int")).alias("state"), "code").count()
    emit = {name: np.zeros((states, size)) for name, size in FEATURES.items()}
    for r in each.toLocalIterator():
        for name, v in unpacked([r["code"]]).items():
            emit[name][r["state"], v[0]] += r["count"]
    step, start = np.full((states, states), 1e-6), np.full(states, 1e-6)
    step[:, ::2] += 1  # who begins to speak may follow on anyone
    start[::2] += 1
    for k in range(len(STATES)):
        step[2 * k : 2 * k + 2, 2 * k + 1] += 1
    within = known.groupBy("role").agg(F.sum((F.size("lines") > 1).cast("long")).alias("first"), F.sum(F.greatest(F.size("lines") - 2, F.lit(0)).cast("long")).alias("further")).collect()
    for r in within:
        step[2 * r["role"], 2 * r["role"] + 1] += r["first"]
        step[2 * r["role"] + 1, 2 * r["role"] + 1] += r["further"]
    for r in known.where("before >= 0").groupBy("before", "role").count().collect():
        step[r["before"], 2 * r["role"]] += r["count"]
    # the first rows of partitions: one row for each, which the last row of the partition before precedes
    part = F.shiftright("stretch", 40)
    last = F.struct("stretch", "i")
    ends = written(rows.groupBy(part.alias("part")).agg(F.max(last).alias("at"), F.max_by("conv", last).alias("conv"), F.max_by(F.when(F.col("role") < 0, -1).otherwise(F.col("role") * 2 + (F.size("lines") > 1).cast("int")), last).alias("state")), "ends")
    heads = rows.where((F.col("before") == -2) & (F.col("stretch") == F.shiftleft(part, 40)) & (F.col("i") == 0)).select(part.alias("part"), F.col("conv").alias("its"), "role")
    order = Window.orderBy("part")
    seen = ends.withColumn("conv0", F.lag("conv").over(order)).withColumn("state0", F.lag("state", 1, -2).over(order)).join(heads, "part")
    seen = seen.select("role", F.when((F.col("state0") != -2) & F.col("conv0").eqNullSafe(F.col("its")), F.col("state0")).otherwise(-2).alias("state0"))
    for r in seen.groupBy("state0", "role").count().collect():
        if r["role"] >= 0 and r["state0"] >= 0:
            step[r["state0"], 2 * r["role"]] += r["count"]
        elif r["role"] >= 0 and r["state0"] == -2:
            start[2 * r["role"]] += r["count"]
    inner = rows.where((F.col("before") == -2) & ~((F.col("stretch") == F.shiftleft(part, 40)) & (F.col("i") == 0)) & (F.col("role") >= 0))
    for r in inner.groupBy("role").count().collect():
        start[2 * r["role"]] += r["count"]
    for name, x in emit.items():
        # a state of few lines has the features of all lines, and of a boundary what is known
        usual = _boundaries() if name == "boundary" else np.tile((x.sum(axis=0) + 1) / (x.sum() + x.shape[1]), (states, 1))
        emit[name] = (x + FEW * usual) / (x.sum(axis=1, keepdims=True) + FEW)
        share = KNOWN if name == "boundary" else USUAL
        emit[name] = share * usual + (1 - share) * emit[name]
    return {"start": np.log(start / start.sum()), "step": np.log(step / step.sum(axis=1, keepdims=True)), "emit": {k: np.log(x) for k, x in emit.items()}}


def _boundaries():
    """The boundary's probabilities as far as they are known beforehand: a marker begins what its role says."""
    import numpy as np

    out = np.full((len(LINE_STATES), FEATURES["boundary"]), MISTAKEN)
    for k, (role, inside) in enumerate(LINE_STATES):
        if inside:
            out[k, 0], out[k, 1] = 1, 0.001
        else:
            out[k, 0], out[k, 1], out[k, 2 + STATES.index(role)] = 0.002, 0.5, 0.5
    return out / out.sum(axis=1, keepdims=True)


def scores(model: dict, codes):
    """Log probability of each line's features under each state: lines by states."""
    return sum(model["emit"][name][:, v].T for name, v in unpacked(codes).items())


def matrix(model: dict, emitted, opens: bool):
    """Best score from each state before a stretch to each state at its end; for a conversation's first stretch all rows are its start's."""
    import numpy as np

    step = model["step"]
    best = (np.tile(model["start"], (len(step), 1)) if opens else step) + emitted[0]
    for e in emitted[1:]:
        best = (best[:, :, None] + step[None]).max(axis=1) + e
    return best


def times(a, b):
    """The max-plus product: from before the first to the end of the second."""
    return (a[:, :, None] + b[None]).max(axis=1)


def through(matrices: list, before: int, end: int) -> list[tuple[int, int]]:
    """(state before, state at the end) of each matrix on the best path; ``before`` -1: any, ``end`` -1: free."""
    best, back = matrices[0][max(before, 0)], []
    for m in matrices[1:]:
        to = best[:, None] + m
        back.append(to.argmax(axis=0))
        best = to.max(axis=0)
    at = int(best.argmax()) if end < 0 else end
    ends = [at]
    for b in reversed(back):
        at = int(b[at])
        ends.append(at)
    ends.reverse()
    return list(zip([before, *ends[:-1]], ends))


def viterbi(model: dict, emitted, before: int = -1, end: int = -1) -> list[int]:
    """The best states; ``before`` is the state before the first line (-1: a conversation's start), ``end`` the last line's (-1: free)."""
    step = model["step"]
    best = (model["start"] if before < 0 else step[before]) + emitted[0]
    back = []
    for e in emitted[1:]:
        to = best[:, None] + step
        back.append(to.argmax(axis=0))
        best = to.max(axis=0) + e
    at = int(best.argmax()) if end < 0 else end
    path = [at]
    for b in reversed(back):
        at = int(b[at])
        path.append(at)
    return path[::-1]


def _stretches(batches):
    """Tables of one stretch each, from rows sorted by stretch."""
    import pyarrow as pa

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(batch.schema.get_field_index("stretch")).to_numpy(zero_copy_only=False)
        cuts = [0, *((ids[1:] != ids[:-1]).nonzero()[0] + 1).tolist(), len(ids)]
        for a, b in zip(cuts, cuts[1:]):
            if held and held[0][0] != ids[a]:
                yield pa.Table.from_batches([x for _, x in held])
                held = []
            held.append((ids[a], batch.slice(a, b - a)))
    if held:
        yield pa.Table.from_batches([x for _, x in held])


def _fixed(rows: DataFrame, model: dict) -> DataFrame:
    """(stretch, before, end), written: the states around each stretch of the conversations that have several."""
    sizes = rows.groupBy("conv").agg(F.min("stretch").alias("head"), F.max("stretch").alias("tail"))
    sizes = written(sizes.where("head < tail"), "long")
    long = rows.join(sizes, rows["conv"].eqNullSafe(sizes["conv"])).select(rows["conv"], "stretch", "lead", "i", (F.col("stretch") == F.col("head")).alias("opens"), "lines")
    kind = rows.schema["conv"].dataType.simpleString()
    n = len(LINE_STATES)

    def reduce(batches):
        import pyarrow as pa

        for t in _stretches(batches):
            codes = t.column("lines").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            m = matrix(model, scores(model, codes), t.column("opens")[0].as_py())
            yield pa.RecordBatch.from_arrays([t.column("conv").slice(0, 1).combine_chunks(), pa.array([t.column("stretch")[0].as_py()]), pa.array([t.column("lead")[0].as_py()]), pa.array([m.ravel().tolist()], pa.list_(pa.float64()))], ["conv", "stretch", "lead", "m"])

    def matrices(pdf) -> list:
        import numpy as np

        return [np.asarray(m, float).reshape(n, n) for m in pdf["m"]]

    def block(pdf):
        import functools

        import pandas as pd

        pdf = pdf.sort_values("stretch")
        return pd.DataFrame({"lead": pdf["lead"].iloc[:1], "m": [functools.reduce(times, matrices(pdf)).ravel().tolist()]})

    def top(pdf):
        import pandas as pd

        pdf = pdf.sort_values("lead")
        return pd.DataFrame([(lead, a, b) for lead, (a, b) in zip(pdf["lead"], through(matrices(pdf), -1, -1))], columns=["lead", "before", "end"])

    def down(pdf):
        import pandas as pd

        pdf = pdf.sort_values("stretch")
        found = through(matrices(pdf), int(pdf["before"].iloc[0]), int(pdf["end"].iloc[0]))
        return pd.DataFrame([(s, a, b) for s, (a, b) in zip(pdf["stretch"], found)], columns=["stretch", "before", "end"])

    reduced = written(map_texts(_sorted(long), reduce, f"conv {kind}, stretch long, lead long, m array<double>"), "matrices")
    blocks = reduced.groupBy("lead").applyInPandas(block, "lead long, m array<double>")
    of = reduced.select("lead", "conv").dropDuplicates(["lead"])
    tops = written(blocks.join(of, "lead").groupBy("conv").applyInPandas(top, "lead long, before int, end int"), "tops")
    return written(reduced.join(tops, "lead").groupBy("lead").applyInPandas(down, "stretch long, before int, end int"), "fixed")


def _sorted(df: DataFrame) -> DataFrame:
    return df.repartition("stretch").sortWithinPartitions("stretch", "i")


def escaped(text: str) -> str:
    """Text in which nothing reads as a turn's mark: ``<|`` gets a backslash, as does ``<\\|`` and so on."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def rendered(role: str, text: str) -> str:
    return _OPEN.format(role) + escaped(text) + _END


def parsed(turns: str) -> list[tuple[str, str]]:
    """(role, text) of rendered turns: what ``rendered`` was given."""
    found = re.findall(r"<\|(\w+)\|>\n(.*?)\n<\|end\|>\n", turns, re.S)
    return [(role, re.sub(r"<(\\*)\\\|", r"<\1|", text)) for role, text in found]


_STRIP = {role: re.compile(p, re.I | re.A) for role, p in MARKERS.items()}


def turns_of(lines: list[str], codes, path: list[int]) -> list[tuple[str, int, str]]:
    """(role, number of lines, text) of each run of one role: markers taken off, blanks at both ends too."""
    marks = unpacked(codes)["boundary"] - 2
    out: list[tuple[str, list[str]]] = []
    for line, mark, state in zip(lines, marks.tolist(), path):
        role = LINE_STATES[state][0]
        if mark >= 0 and STATES[mark] == role:
            line = _STRIP[role].sub("", line, count=1)
        if not out or out[-1][0] != role:
            out.append((role, []))
        out[-1][1].append(line)
    return [(role, len(said), "\n".join(said).strip()) for role, said in out]


def recover(turns: DataFrame, conv_col: str = "conv_id", order_col: str = "turn", text_col: str = "text", role_col: str | None = "role", model: dict | None = None, stretch: int = STRETCH) -> DataFrame:
    """(``conv_col``, ``order_col``, part, role, n_lines, rendered): the turns of each row, numbered from 0 by ``part``.

    A row is a message, or a whole transcript of several speakers (then one row, one
    conversation). Its lines get their roles by Viterbi over the conversation, and each
    run of one role in it is a turn: ``<|role|>``, the text without speaker markers and
    outer blanks, ``<|end|>``, by lines. Marks inside of the text are escaped; ``parsed`` undoes that.

    ``role_col`` is only used to learn from (null or another name: not learned from);
    ``model`` comes from ``learn`` or is learned from these rows.

    Null texts are one empty line, so each row has one turn at least. A null conversation is one conversation. Rows of
    equal turns are ordered by a hash of their text; repeated rows each have their
    place. Long texts are parsed whole. Other columns are not looked at. No rows, no result.
    """
    rows = ordered(turns, conv_col, order_col, text_col, role_col, stretch)
    model = model or learn(rows)
    placed = rows.join(_fixed(rows, model).withColumnRenamed("before", "from"), "stretch", "left").select("conv", "turn", "text", "stretch", "i", "lines", F.coalesce("from", F.lit(-1)).alias("from"), F.coalesce("end", F.lit(-1)).alias("end"))
    kind, order = (rows.schema[c].dataType.simpleString() for c in ("conv", "turn"))

    def decode(batches):
        import numpy as np
        import pyarrow as pa

        for t in _stretches(batches):
            each = [np.asarray(x) for x in t.column("lines").to_pylist()]
            path = viterbi(model, scores(model, np.concatenate(each)), t.column("from")[0].as_py(), t.column("end")[0].as_py())
            at, rows_, out = 0, [], []
            for k, (text, codes) in enumerate(zip(t.column("text").to_pylist(), each)):
                said = turns_of(text.split("\n"), codes, path[at : at + len(codes)])
                at += len(codes)
                rows_ += [k] * len(said)
                out += [(p, role, n, rendered(role, x)) for p, (role, n, x) in enumerate(said)]
            keys = t.select(["conv", "turn"]).take(pa.array(rows_, pa.int64())).combine_chunks()
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.string())
            columns = [keys.column(c).combine_chunks() if keys.num_rows else pa.array([], keys.schema.field(c).type) for c in ("conv", "turn")]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], ["conv", "turn", "part", "role", "n_lines", "rendered"])

    out = map_texts(_sorted(placed), decode, f"conv {kind}, turn {order}, part int, role string, n_lines int, rendered string")
    return out.select(F.col("conv").alias(conv_col), F.col("turn").alias(order_col), "part", "role", "n_lines", "rendered")


def op6_chat_format(spark, sf_dir: str) -> DataFrame:
    return recover(table(spark, sf_dir, "conversations"))
