"""Language ID by a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

The cell is a minimal gated unit: f = sigmoid(A[x] + U h), c = tanh(B[x] + f * (V h)), h' = h + f * (c - h). One cell runs
forwards and one backwards over segments of SEGMENT bytes; a linear layer on both states gives language probabilities at
every byte, and a document's probability is their mean over all bytes of the whole text.
"""

from __future__ import annotations

import random
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import share, small_or_shuffled, utf8

#: Bytes of a segment, state size of each direction, segments that run side by side.
SEGMENT, HIDDEN, ABREAST = 96, 8, 2048
#: The fit's sample: at most so many documents of each language; every language of the table is learned.
SAMPLE_PER_LANG = 600
STEPS, BATCH, RATE = 260, 192, 0.02
UND = "und"
LETTER = r"\p{L}"


class Net:
    """Weights; per direction A and B joined as E (2H x 256) and U and V joined as R (2H x H)."""

    def __init__(self, langs: list[str], seed: int = 7, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.langs, self.hidden = langs, hidden
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.w = {}
        for d in "fb":
            self.w["E" + d] = draw(2 * hidden, 256, scale=0.3)
            self.w["R" + d] = draw(2 * hidden, hidden, scale=0.3)
            self.w["O" + d] = draw(len(langs), hidden, scale=0.3)
        self.w["o"] = np.zeros((len(langs), 1), np.float32)

    def _run(self, d: str, x: np.ndarray, live: np.ndarray, keep: bool):
        """States after each byte of x (T x B), in the direction d; with keep also what the way back needs."""
        H, E, R = self.hidden, self.w["E" + d], self.w["R" + d]
        T, B = x.shape
        h, states, trace = np.zeros((H, B), np.float32), np.empty((T, H, B), np.float32), []
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            a = np.take(E, x[t], axis=1)
            r = R @ h
            f = a[:H]
            f += r[:H]
            f *= 0.5
            np.tanh(f, out=f)
            f += 1
            f *= 0.5
            c = f * r[H:]
            c += a[H:]
            np.tanh(c, out=c)
            step = c - h
            step *= f
            if not live[t].all():
                step *= live[t]
            if keep:
                trace.append((t, h, f, c, r[H:]))
            h = h + step
            states[t] = h
        return states, trace

    def probabilities(self, x: np.ndarray, live: np.ndarray):
        sf, _ = self._run("f", x, live, False)
        sb, _ = self._run("b", x, live, False)
        z = np.matmul(self.w["Of"], sf) + np.matmul(self.w["Ob"], sb) + self.w["o"]
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z  # T x C x B

    def gradients(self, x: np.ndarray, live: np.ndarray, y: np.ndarray):
        """Loss and gradients of the mean cross-entropy at all live bytes, by backpropagation through time."""
        H, w = self.hidden, self.w
        runs = {d: self._run(d, x, live, True) for d in "fb"}
        z = np.matmul(w["Of"], runs["f"][0]) + np.matmul(w["Ob"], runs["b"][0]) + w["o"]
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        n, cols = max(1.0, float(live.sum())), np.arange(x.shape[1])
        loss = -float((np.log(p[:, y, cols] + 1e-12) * live).sum()) / n
        p[:, y, cols] -= 1
        p *= (live / n)[:, None, :]
        g = {k: np.zeros_like(v) for k, v in w.items()}
        g["o"] = p.sum(axis=(0, 2))[:, None]
        for d in "fb":
            states, trace = runs[d]
            g["O" + d] = np.einsum("tcb,thb->ch", p, states, optimize=True)
            R, dh = w["R" + d], np.zeros((H, x.shape[1]), np.float32)
            for t, h, f, c, v in reversed(trace):
                dh += w["O" + d].T @ p[t]
                on = live[t]
                dc = dh * f * (1 - c * c) * on
                df = (dh * (c - h) * on + dc * v) * f * (1 - f)
                dr = np.concatenate([df, dc * f])
                np.add.at(g["E" + d].T, x[t], np.concatenate([df, dc]).T)
                g["R" + d] += dr @ h.T
                dh = dh * (1 - f * on) + R.T @ dr
        return loss, g


def fit(texts: list[bytes], labels: list[str], seed: int = 7, steps: int = STEPS) -> Net | None:
    """A network from labelled texts, which are cut to segments; None without any. Languages weigh alike."""
    langs = sorted(set(labels))
    if not langs:
        return None
    net, rng = Net(langs, seed), np.random.default_rng(seed)
    if len(langs) == 1:
        return net
    x, live, doc = segments(texts)
    y = np.array([langs.index(v) for v in labels])[doc]
    groups = [g for k in range(len(langs)) if len(g := np.flatnonzero(y == k))]
    m, v = ({k: np.zeros_like(a) for k, a in net.w.items()} for _ in range(2))
    for i in range(1, steps + 1):
        pick = np.concatenate([rng.choice(g, max(1, BATCH // len(groups))) for g in groups])
        _, grads = net.gradients(x[:, pick], live[:, pick], y[pick])
        rate = RATE * min(1.0, 2 * (1 - i / (steps + 1)))
        for k, g in grads.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            net.w[k] -= (rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-7)).astype(np.float32)
    return net


def segments(texts: list[bytes], size: int = SEGMENT):
    """All bytes of all texts as columns of `size` bytes (T x B), which of them are live, and the text of each column."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    n = -(-lens // size)
    doc = np.repeat(np.arange(len(texts)), n)
    at = np.concatenate(([0], np.cumsum(n)[:-1])) * size if len(texts) else np.zeros(0, np.int64)
    flat, live = np.zeros(int(n.sum()) * size, np.uint8), np.zeros(int(n.sum()) * size, np.float32)
    for i, t in enumerate(texts):
        flat[at[i] : at[i] + lens[i]] = np.frombuffer(t, np.uint8)
        live[at[i] : at[i] + lens[i]] = 1
    return np.ascontiguousarray(flat.reshape(-1, size).T), np.ascontiguousarray(live.reshape(-1, size).T), doc


def pooled(net: Net, texts: list[bytes]) -> np.ndarray:
    """Mean over all bytes of each text of the probabilities (texts x languages); rows of no bytes are 0."""
    total, lens = np.zeros((len(texts), len(net.langs))), np.fromiter(map(len, texts), np.int64, len(texts))
    whose, parts = [], []

    def run():
        x, live, doc = segments(parts)
        for i in range(0, len(doc), ABREAST):
            on = live[:, i : i + ABREAST]
            p = net.probabilities(np.ascontiguousarray(x[:, i : i + ABREAST]), on)
            np.add.at(total, np.asarray(whose)[doc[i : i + ABREAST]], np.einsum("tcb,tb->bc", p, on))
        whose.clear()
        parts.clear()

    step, held = SEGMENT * ABREAST, 0
    for i, t in enumerate(texts):
        for j in range(0, len(t), step):
            whose.append(i)
            parts.append(t[j : j + step])
            held += len(parts[-1])
            if held >= step:
                run()
                held = 0
    if parts:
        run()
    return total / np.maximum(lens, 1)[:, None]


def held_out():
    """crc32 of doc_id as text, mod 3, is 1; false for a null doc_id, which isn't learned from either."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def noise(n: int, seed: int = 5) -> list[bytes]:
    """Parts of SEGMENT characters that are of no language: letters, digits and signs drawn evenly, hex, base64, words of
    even letters, code points of any script, one character over and over. The same for the same seed."""
    rng = random.Random(seed)
    ascii_, letters = [chr(c) for c in range(33, 127)], string.ascii_lowercase
    # Scripts by their code points, of which a language uses few at a time: Greek to Arabic, South Asian, Georgian to Cherokee, CJK.
    scripts = [(0x370, 0x6FF), (0x900, 0xDFF), (0x10A0, 0x13FF), (0x3041, 0x9FFF), (0xAC00, 0xD7A3)]

    def words(pick):
        out = ""
        while len(out) < SEGMENT:
            out += "".join(pick() for _ in range(rng.randint(2, 10))) + " "
        return out

    def drawn(kind):
        if kind < 3:
            return "".join(rng.choices((ascii_, "0123456789abcdef", string.ascii_letters + string.digits + "+/")[kind], k=SEGMENT))
        if kind == 3:
            some = rng.sample(letters, rng.randint(6, 26))
            return words(lambda: rng.choice(some))
        if kind == 4:
            low, high = rng.choice(scripts)
            return words(lambda: chr(rng.randint(low, high)))
        return rng.choice(ascii_) * SEGMENT

    return [drawn(i % 6)[:SEGMENT].encode() for i in range(n)]


def train(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, with_noise: bool = False) -> Net | None:
    """Fits on a bounded sample of documents with a language, text and id that aren't held out, the same for the same table:
    of each language those with the least hashes of doc_id, and of each a part of SEGMENT characters at a hashed place. With
    noise, the network also learns what is of no language, as `und`."""
    usable = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(LETTER)).select("doc_id", "lang", "text")
    counts = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull()).groupBy("lang").count()
    h = F.xxhash64("doc_id")
    share = F.pmod(h, F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = usable.join(small_or_shuffled(counts), "lang").where(share < F.lit(3.0 * per_lang) / F.col("count")).withColumn("h", h)
    place = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - SEGMENT + 1, F.lit(1))) + 1
    rows = some.select("lang", "h", "doc_id", F.substr("text", place.cast("int"), F.lit(SEGMENT)).alias("part")).withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("nth") <= per_lang)
    rows = rows.orderBy("lang", "nth").select("lang", "part").collect()
    extra = noise(per_lang) if with_noise and rows else []
    return fit([r[1].encode() for r in rows] + extra, [r[0] for r in rows] + [UND] * len(extra))


def predict(docs: DataFrame, net: Net | None) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs: the language of the greatest pooled probability (ties: the first by
    name) and that probability. Text that is null, empty or without letters is `und` with score 0, as is all text if no
    language was learned. Repeated rows get the same prediction; very long texts stream through segment by segment."""
    shared = share(docs.sparkSession, net)

    def run(batches):
        net = shared()
        for b in batches:
            texts = [t or b"" for t in utf8(b.column(1))]
            letters = b.column(2).to_pylist()
            if net is None:
                lang, score = [UND] * len(texts), [0.0] * len(texts)
            else:
                p = pooled(net, [t if ok else b"" for t, ok in zip(texts, letters)])
                best = p.argmax(axis=1)
                lang = [net.langs[k] if ok else UND for k, ok in zip(best, letters)]
                score = [min(1.0, float(p[i, k])) if ok else 0.0 for i, (k, ok) in enumerate(zip(best, letters))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    own = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(LETTER), F.lit(False)).alias("letters"))
    return own.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


#: A document is rejected if it has no letter, if more than this of its probability is noise's, or if no language reaches that
#: mean probability.
MOST_NOISE, LEAST_SCORE = 0.65, 0.3


def keep_identified(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs, all columns, whose language is told: a language has a pooled probability of `least` or more, and noise
    one of MOST_NOISE at most.

    Null and empty texts and texts without letters go; repeated rows share their fate; an empty table, or one without any
    labelled text, gives no rows; very long texts stream through. The network is fitted with noise as a class of its own.
    """
    net = train(docs, with_noise=True)
    shared = share(docs.sparkSession, net)
    at = docs.columns.index("text")

    def run(batches):
        net = shared()
        for b in batches:
            if net is not None:
                p = pooled(net, [t or b"" for t in utf8(b.column(at))])
                told = np.array([v != UND for v in net.langs])
                best = p[:, told].max(axis=1)
                yield b.filter(pa.array((best >= least) & (p[:, ~told].max(axis=1, initial=0.0) <= MOST_NOISE)))

    return docs.where(F.col("text").rlike(LETTER)).mapInArrow(run, docs.schema)
