"""Chat formatting by transcript parsing: a hidden Markov model over speaker markers and line features recovers the roles by
Viterbi; turns are then rendered in one canonical form.

Lines are sorted once over all partitions, so a conversation of any length is spread over many. Viterbi is max-plus algebra:
a piece of a conversation in one partition is a matrix from the state before it to its last state. The driver sees the two
outer pieces of each partition, chooses the states at the seams, and each piece is then decoded between its seams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import shared_dir

ROLES = ("system", "user", "assistant")
#: Fixed speaker markers at the start of a line, by role.
MARKERS = {
    "system": r"(?is)^\s*(?:<\|(?:im_start\|>)?\s*system\b|\[?system\]?\s*[:>]|#+\s*(?:system|context)\b|<<sys>>)",
    "user": r"(?is)^\s*(?:<\|(?:im_start\|>)?\s*user\b|\[?(?:user|human|customer|q|me)\]?\s*[:>]|#+\s*(?:user|human|instruction|question)\b|\[inst\])",
    "assistant": r"(?is)^\s*(?:<\|(?:im_start\|>)?\s*assistant\b|\[?(?:assistant|bot|ai|agent|model|a)\]?\s*[:>]|#+\s*(?:assistant|response|answer)\b)",
}
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
N, LENGTHS = len(ROLES), 20
#: Feature counts of the emission: marker, length class (quarter octaves from 16), ends in a question mark, several lines.
SHAPE = (N + 1, LENGTHS, 2, 2)
SMOOTH = 0.5
#: Added to the count of each marker with each role, and to that of a role's own marker, as a share of the role's lines.
#: Share of the even distribution in the features' own, so that no unseen shape outweighs a marker.
FLAT = 0.1
OTHERS, OWN = 0.001, 0.2


def observations(lines: DataFrame, key: str, order: list[str], role: str | None) -> DataFrame:
    """key, the order columns, text, known (index of the role, -1 if unknown) and obs (index of the emission's cell)."""
    text = F.coalesce("text", F.lit(""))
    marker = F.lit(0)
    for i, r in enumerate(ROLES):
        marker = F.when(text.rlike(MARKERS[r]), i + 1).otherwise(marker)
    size = F.least(F.greatest(F.floor(2 * F.log2(F.length(text) + 1.0) - 4), F.lit(0)), F.lit(LENGTHS - 1))
    ask, many = text.rlike(r"[?？]\s*$").cast("int"), F.contains(F.trim(text), F.lit("\n")).cast("int")
    obs = ((marker * LENGTHS + size) * 2 + ask) * 2 + many
    known = F.lit(-1)
    for i, r in enumerate(ROLES) if role else ():
        known = F.when(F.lower(role) == r, i).otherwise(known)
    return lines.select(F.col(key).alias("key"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], "text", known.alias("known"), obs.cast("int").alias("obs"))


class Model:
    """Log probabilities: start (N), move (N x N), emit (N x cells)."""

    def __init__(self, start, move, emit):
        norm = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
        self.start, self.move, self.emit = norm(start), norm(move), norm(emit)

    @classmethod
    def fit(cls, first: np.ndarray, pairs: np.ndarray, cells: np.ndarray) -> Model:
        """From counts. Features count as independent given the role; a speaker marker, where none was seen with a role,
        still speaks for its own role."""
        parts = cells.reshape(N, *SHAPE)
        seen = parts.sum(axis=(2, 3, 4))
        marker = seen + OTHERS
        for i in range(N):
            marker[i, i + 1] += max(2.0, OWN * seen[i].sum())
        axes = [marker, parts.sum(axis=(1, 3, 4)) + SMOOTH, parts.sum(axis=(1, 2, 4)) + SMOOTH, parts.sum(axis=(1, 2, 3)) + SMOOTH]
        axes = [a / a.sum(axis=1, keepdims=True) for a in axes]
        axes[1:] = [(1 - FLAT) * a + FLAT / a.shape[1] for a in axes[1:]]
        emit = np.einsum("ra,rb,rc,rd->rabcd", *axes).reshape(N, -1)
        return cls(first + SMOOTH, pairs + SMOOTH, emit)


def viterbi(model: Model, obs, enter: int | None = None, leave: int | None = None) -> list[int]:
    """The likeliest roles; of equally likely ones the first by index from the end. enter: the role just before; leave: the
    role of the last line, where they are fixed."""
    move, emit = model.move, model.emit
    score = emit[:, obs[0]] + (model.start if enter is None else move[enter])
    back = []
    for o in obs[1:]:
        step = score[:, None] + move
        back.append(step.argmax(axis=0))
        score = step.max(axis=0) + emit[:, o]
    path = [int(score.argmax()) if leave is None else leave]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def matrix(model: Model, obs) -> np.ndarray:
    """(before, last): the best score of a piece between the role before it and its last line's role; row N: it starts."""
    score = np.vstack([model.move, model.start]) + model.emit[:, obs[0]]
    for o in obs[1:]:
        score = (score[:, :, None] + model.move[None]).max(axis=1) + model.emit[:, o]
    return score


def _groups(batches):
    """Runs of equal keys in sorted batches: (key, rows), a batch at a time."""
    for b in batches:
        keys = b.column(0).to_pylist()
        cut = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for i, j in zip(cut, cut[1:]):
            if j > i:
                yield keys[i], b.slice(i, j - i)


def _pieces(batches):
    """(key, list of slices) for each piece of a conversation in this partition, whole."""
    now, held = None, []
    for key, part in _groups(batches):
        if held and key != now:
            yield now, held
            held = []
        now = key
        held.append(part)
    if held:
        yield now, held


def _column(parts, name):
    return np.concatenate([p.column(p.schema.names.index(name)).to_numpy(zero_copy_only=False) for p in parts])


def _text(key) -> pa.Array:
    return pa.array([None if key is None else str(key)], pa.string())


def _train(obs: DataFrame):
    """Counts over all known lines: emission cells by Spark; starts and moves from a pass over the sorted partitions, whose
    seams the driver closes with each partition's first and last line."""
    cells = np.zeros((N, int(np.prod(SHAPE))))
    for r, o, n in obs.where("known >= 0").groupBy("known", "obs").count().collect():
        cells[r, o] = n

    def count(batches):
        first, pairs, ends, rows = np.zeros(N), np.zeros((N, N)), None, 0
        last = (None, -1)
        for key, part in _groups(batches):
            k = part.column(part.schema.names.index("known")).to_numpy(zero_copy_only=False)
            prev = last[1] if rows and key == last[0] else None
            if prev is None and k[0] >= 0 and rows:
                first[k[0]] += 1
            both = np.r_[[] if prev is None else [prev], k].astype(np.int64)
            ok = (both[1:] >= 0) & (both[:-1] >= 0)
            np.add.at(pairs, (both[:-1][ok], both[1:][ok]), 1)
            ends = ends or (key, int(k[0]))
            last, rows = (key, int(k[-1])), rows + len(k)
        if rows:
            flat = [*first, *pairs.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([flat], pa.list_(pa.float64())), _text(ends[0]), pa.array([ends[1]]), _text(last[0]), pa.array([last[1]])], ["part", "counts", "first_key", "first_role", "last_key", "last_role"])

    total, before = np.zeros(N + N * N), None
    for part, counts, k0, r0, k1, r1 in sorted(obs.mapInArrow(count, "part int, counts array<double>, first_key string, first_role long, last_key string, last_role long").collect(), key=lambda r: r[0]):
        total += counts
        if before is not None and before[0] == k0:
            if before[1] >= 0 and r0 >= 0:
                total[N + N * before[1] + r0] += 1
        elif r0 >= 0:
            total[r0] += 1
        before = (k1, r1)
    return Model.fit(total[:N], total[N:].reshape(N, N), cells)


def _seams(obs: DataFrame, model: Model) -> dict[int, dict[str, tuple]]:
    """For each partition the fixed roles (before, last) of its first and its last piece where the conversation goes on."""

    def outer(batches):
        first = last = None
        for i, (key, parts) in enumerate(_pieces(batches)):
            o = _column(parts, "obs") if i == 0 else None
            if i == 0:
                first = (key, matrix(model, o).ravel().tolist())
                last = first
            else:
                last = (key, parts)
        if first:
            if last is not first:
                last = (last[0], matrix(model, _column(last[1], "obs")).ravel().tolist())
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([last is first]), _text(first[0]), pa.array([first[1]], pa.list_(pa.float64())), _text(last[0]), pa.array([last[1]], pa.list_(pa.float64()))], ["part", "one", "k0", "m0", "k1", "m1"])

    rows = sorted(obs.mapInArrow(outer, "part int, one boolean, k0 string, m0 array<double>, k1 string, m1 array<double>").collect(), key=lambda r: r[0])
    pieces = []
    for part, one, k0, m0, k1, m1 in rows:
        pieces.append((part, "first", k0, np.array(m0).reshape(N + 1, N)))
        if not one:
            pieces.append((part, "last", k1, np.array(m1).reshape(N + 1, N)))
    fixed, i = {}, 0
    while i < len(pieces):
        j = i + 1
        while j < len(pieces) and pieces[j][2] == pieces[i][2] and pieces[j][0] != pieces[j - 1][0]:
            j += 1
        if j - i > 1:
            score, back = pieces[i][3][N], []
            for _, _, _, m in pieces[i + 1 : j]:
                step = score[:, None] + m[:N]
                back.append(step.argmax(axis=0))
                score = step.max(axis=0)
            roles = [int(score.argmax())]
            for b in reversed(back):
                roles.append(int(b[roles[-1]]))
            roles.reverse()
            for n, (part, which, _, _) in enumerate(pieces[i:j]):
                fixed.setdefault(part, {})[which] = (roles[n - 1] if n else None, roles[n], n < j - i - 1)
        i = j
    return fixed


def _sorted_lines(lines: DataFrame, key: str, order: tuple[str, ...], role: str | None) -> DataFrame:
    """Observations in the order of key, the order columns and text, written once, so that partitions stay as they are."""
    shared_dir(lines.sparkSession)
    by = ["key", *(f"o{i}" for i in range(len(order))), "text"]
    return observations(lines, key, list(order), role).repartitionByRange(*by).sortWithinPartitions(*by).checkpoint()


def fit_model(lines: DataFrame, key: str = "conv_id", order: tuple[str, ...] = ("turn",), role: str = "role") -> Model:
    """The model of lines whose roles are known, to recover those of others."""
    return _train(_sorted_lines(lines, key, order, role))


def recover_roles(lines: DataFrame, key: str = "conv_id", order: tuple[str, ...] = ("turn",), role: str | None = "role", model: Model | None = None) -> DataFrame:
    """key, order columns, role_pred, starts_turn and rendered, for each row.

    Lines are read in the order of key and order (null first), then text; a turn is a longest run of lines of one role in a
    conversation; rendered texts of a conversation, put together in order, are its canonical form. The model is fitted on
    the rows whose role column names a known role, or given. Null text counts as empty, a null key is one conversation,
    unknown or null roles are not learned from but are recovered, repeated rows are lines of their own, an empty table gives
    no rows; a speaker marker is kept in the text.
    """
    names = [f"o{i}" for i in range(len(order))]
    obs = _sorted_lines(lines, key, order, role)
    model = model or _train(obs)
    fixed = _seams(obs, model)
    schema = obs.select("key", *names, "text").schema.add("role_pred", "string").add("starts", "boolean").add("first", "boolean").add("last", "boolean")

    def decode(batches):
        mine, held, count = fixed.get(TaskContext.get().partitionId(), {}), None, 0

        def done(piece, which):
            parts, (enter, leave, goes_on) = piece[1], mine.get(which, (None, None, False))
            path = np.array(viterbi(model, _column(parts, "obs"), enter, leave))
            starts = np.r_[enter is None or enter != path[0], path[1:] != path[:-1]]
            first, last = np.zeros((2, len(path)), bool)
            first[0], last[-1] = enter is None, not goes_on
            at = 0
            for p in parts:
                n = p.num_rows
                cut = slice(at, at + n)
                at += n
                yield pa.RecordBatch.from_arrays([*(p.column(p.schema.names.index(c)) for c in ("key", *names, "text")), pa.array([ROLES[r] for r in path[cut]]), pa.array(starts[cut]), pa.array(first[cut]), pa.array(last[cut])], names=["key", *names, "text", "role_pred", "starts", "first", "last"])

        for piece in _pieces(batches):
            if held is not None:
                yield from done(held, "first" if count == 1 else "")
            held, count = piece, count + 1
        if held is not None:
            yield from done(held, "first" if count == 1 else "last")

    out = obs.mapInArrow(decode, schema)
    opened = F.concat(F.when(F.col("first"), "").otherwise(CLOSE + "\n"), F.lit(OPEN), "role_pred", F.lit("\n"))
    rendered = F.concat(F.when(F.col("starts"), opened).otherwise("\n"), F.coalesce("text", F.lit("")), F.when(F.col("last"), CLOSE + "\n").otherwise(""))
    return out.select(F.col("key").alias(key), *[F.col(n).alias(c) for n, c in zip(names, order)], "role_pred", F.col("starts").alias("starts_turn"), rendered.alias("rendered"))


def transcript_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, turn, text: the lines of raw transcripts, numbered from 0, blank ones left out; the input of recover_roles."""
    return docs.select(F.col(key), F.posexplode(F.split(text, "\n")).alias("turn", "text")).where("trim(text) <> ''")


def op8_transcripts(spark, sf_dir: str) -> DataFrame:
    return recover_roles(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
