"""Language-model scores from a class-based bigram model with exchange clustering (operator 3).

Tokens are words (lower-cased A-Z, split at ASCII white space) and one end for each text; a text is preceded by an
end as history.  Training texts are those whose crc32(doc_id as text) mod 7 is not 2, all of them and whole.

1. All training tokens are counted, each task summing its own before the shuffle; the table of counts stays
   distributed.
2. The number of classes is ``SCALE`` times the fourth root of the number of words seen at least ``SEEN`` times, so it
   grows with the corpus.  Bigrams of the ``PER_CLASS`` most frequent words a class, of the end and of "any other word" are
   counted over all training texts, and exchange clustering finds the classes of those words: each word in turn moves to
   the class that gives the class bigram model the highest likelihood, until none moves or ``ROUNDS`` are over.
3. Every other training word seen at least ``SEEN`` times gets one of these classes: its neighbours' classes are
   counted over all training texts, and it goes where the likelihood gains most, by the same measure as in 2, against the
   classes found there.  Counts and classes stay distributed; the ``HEAD`` most frequent words go to the workers, a
   fixed number whatever the corpus, the others are joined.  Words seen less often stand for the unseen ones: both
   are one class of their own.
4. P(text) = product of P(class | class before) * P(word | class).  Transitions are counted over all training texts with
   the classes of all words, and smoothed by the class frequencies (weight ``ALPHA``); the end is a class of its own; a word
   has its share of its class.  The class of rare and unseen words has emission (c + 1) / (N' + V' + 1), c the word's
   count, N' and V' the class's tokens and words, so an unseen word has the same chance as a word seen no time and
   all sums are one.

Words are named by 64-bit hashes.

Defined cases: null text is empty and consists of its end; null doc_ids are trained on and not held out;
repeated rows are counted and scored each; with no training tokens every count is 0; an empty table gives an
empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..plans.store import stored
from . import words as W

HEAD = 200_000
SCALE = 2.4
PER_CLASS = 20
ROUNDS = 8
ALPHA = 20.0
#: Words seen less often have no class of their own but model the unseen ones.
SEEN = 2
#: In a sequence of classes: a word that the workers don't know.
OPEN = 65_535
#: Size of a worker's tables of words by classes.
CELLS = 200_000
#: The end's name; hashes of words are shifted away from it.
END = np.uint64(0)


def _rows(docs: DataFrame) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))


def _tokens(chunk: W.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end after each document, and the borders between documents."""
    starts, ends, first = W.runs(chunk, ~W.IS_SPACE)
    h = W.hash_spans(chunk.data, starts, ends)
    h[h == END] = 1
    return np.insert(h, first[1:], END), first + np.arange(chunk.n + 1)


def _sum(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, count = key[order], count[order]
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[cut], np.add.reduceat(count, cut) if len(key) else count


def sizes(kinds: int) -> tuple[int, int]:
    """Number of classes, and of words that the exchange moves, for so many words seen at least ``SEEN`` times."""
    classes = max(1, round(SCALE * kinds**0.25))
    return classes, PER_CLASS * classes


def _tally(found: Iterator[np.ndarray], name: str) -> Iterator[pa.RecordBatch]:
    """``name, c``: how often each key occurs, in all the arrays or, where there are many keys, in runs of them."""
    keys, counts, held = [], [], 0
    out = lambda k, c: pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], [name, "c"])
    for x in found:
        k, c = np.unique(x, return_counts=True)
        keys, counts, held = [*keys, k], [*counts, c], held + len(k)
        if held > 1_000_000:
            k, c = _sum(keys, counts)
            if len(k) > 500_000:
                yield out(k, c)
                k, c = k[:0], c[:0]
            keys, counts, held = [k], [c], len(k)
    if keys:
        yield out(*_sum(keys, counts))


def _unigrams(rows: DataFrame) -> DataFrame:
    """``word, c``: counts of all training tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _tally((_tokens(chunk)[0] for batch in batches for chunk in W.chunks(batch.column(0), lower=True)), "word")

    return rows.filter("not held_out").select("text").mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _bigrams(rows: DataFrame, clustered) -> np.ndarray:
    """Counts of (token, next token) over the clustered words, then "other", then the end, in all training texts."""
    size = len(clustered.value) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = clustered.value
        order = np.argsort(known)
        ordered = known[order]

        def pairs(chunk: W.Chunk) -> np.ndarray:
            number = _number(_tokens(chunk)[0], ordered, order)
            return np.concatenate([[size - 1], number[:-1]]) * size + number

        yield from _tally((pairs(chunk) for batch in batches for chunk in W.chunks(batch.column(0), lower=True)), "pair")

    found = rows.filter("not held_out").select("text").mapInArrow(run, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(size * size)
    out[found.column("pair").to_numpy()] = found.column("c").to_numpy()
    return out.reshape(size, size)


def _number(tokens: np.ndarray, known: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Place of each token among the clustered words; the number of words for another, one more for the end."""
    at, there = W.find(known, tokens)
    out = np.where(there, names[at] if len(names) else 0, len(known))
    out[tokens == END] = len(known) + 1
    return out


def exchange(bigrams: np.ndarray, classes: int, rounds: int) -> np.ndarray:
    """Class of each word by exchange clustering; the last two rows (other, end) are classes of their own,
    ``classes`` and ``classes + 1``.  Words start dealt round in order of frequency; ties go to the lower class."""
    n = len(bigrams) - 2
    total = classes + 2
    of = np.concatenate([np.arange(n) % classes, [classes, classes + 1]]).astype(np.int64)
    phi = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)
    member = np.zeros((n + 2, total))
    member[np.arange(n + 2), of] = 1
    right, left = bigrams @ member, bigrams.T @ member  # word to class, class to word
    m = member.T @ right
    out, into = bigrams.sum(axis=1), bigrams.sum(axis=0)
    sent, got = out @ member, into @ member
    for _ in range(rounds):
        moved = 0
        for w in np.argsort(-out[:n], kind="stable"):
            g, self_ = of[w], bigrams[w, w]
            r, c = right[w].copy(), left[w].copy()
            r[g] -= self_
            c[g] -= self_
            m[g] -= r
            m[:, g] -= c
            m[g, g] -= self_
            sent[g] -= out[w]
            got[g] -= into[w]
            k = np.arange(classes)
            gain = (phi(m[:classes] + r) - phi(m[:classes])).sum(axis=1) + (phi(m[:, :classes] + c[:, None]) - phi(m[:, :classes])).sum(axis=0)
            d = m[k, k]
            gain += phi(d + r[k] + c[k] + self_) - phi(d + r[k]) - phi(d + c[k]) + phi(d)
            gain -= phi(sent[k] + out[w]) - phi(sent[k]) + phi(got[k] + into[w]) - phi(got[k])
            new = int(np.argmax(gain))
            if gain[new] <= gain[g] + 1e-9:
                new = g
            m[new] += r
            m[:, new] += c
            m[new, new] += self_
            sent[new] += out[w]
            got[new] += into[w]
            if new != g:
                moved += 1
                of[w] = new
                right[:, g] -= bigrams[:, w]
                right[:, new] += bigrams[:, w]
                left[:, g] -= bigrams[w]
                left[:, new] += bigrams[w]
        if not moved:
            break
    return of


def transitions(bigrams: np.ndarray, of: np.ndarray, classes: int) -> np.ndarray:
    """log10 P(class | class before), smoothed by the add-one frequency of classes."""
    member = np.zeros((len(of), classes + 2))
    member[np.arange(len(of)), of] = 1
    m = member.T @ bigrams @ member
    into = m.sum(axis=0) + 1
    p = (m + ALPHA * into / into.sum()) / (m.sum(axis=1, keepdims=True) + ALPHA)
    return np.log10(p)


def gains(word: np.ndarray, pair: np.ndarray, count: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What the likelihood gains by each class for the words 0, 1, ... in ``word`` (ascending), up to a constant of each word.

    ``pair``: class before * all classes + class after, of ``count`` occurrences; ``m``: class bigrams without these words.
    The last two classes (other, end) are contexts only."""
    total, classes, n = len(m), len(m) - 2, int(word[-1]) + 1
    phi = lambda x: x * np.log(np.maximum(x, 1.0))  # noqa: E731 - counts are 0 or at least 1
    sides = []
    for side, at in ((m[:, :classes], pair // total), (m[:classes].T, pair % total)):
        key, c = _sum([word * total + at], [count])
        sides.append((key // total, key % total, c.astype(float), side))
    out = np.zeros((n, classes))
    for w, ctx, c, side in sides:
        have = side[ctx]
        gain = phi(have + c[:, None]) - phi(have)
        out += np.add.reduceat(gain, np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])), axis=0)
    # a class's bigrams with itself take up both sides
    l, r = (np.zeros((n, total)) for _ in range(2))
    for x, (w, ctx, c, _) in zip((l, r), sides, strict=True):
        x[w, ctx] = c
    l, r, d = l[:, :classes], r[:, :classes], np.diag(m)[:classes]
    out += phi(d + l + r) - phi(d + l) - phi(d + r) + phi(d)
    all_ = np.bincount(word, count, n)[:, None]
    for size in (m.sum(axis=1)[:classes], m.sum(axis=0)[:classes]):
        out -= phi(size + all_) - phi(size)
    return out


def _classes(rows: DataFrame, core: np.ndarray, of: np.ndarray, m: np.ndarray) -> DataFrame:
    """``word, c, class`` of all training words but those in ``core``; rarer ones than ``SEEN`` are of class other."""
    total = len(m)
    known = rows.sparkSession.sparkContext.broadcast((core, of, m))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, of, _ = known.value
        order = np.argsort(core)
        sorted_core = core[order]
        for batch in batches:
            for chunk in W.chunks(batch.column(0), lower=True):
                tokens, _ = _tokens(chunk)
                number = _number(tokens, sorted_core, order)
                cls = of[number]
                at = np.flatnonzero(number == len(core))
                word, pair = tokens[at], np.where(at > 0, cls[at - 1], total - 1) * total + cls[at + 1]
                order_ = np.lexsort((pair, word))
                word, pair = word[order_], pair[order_]
                cut = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (pair[1:] != pair[:-1])])) if len(word) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(word[cut].view(np.int64)), pa.array(pair[cut].astype(np.int32)), pa.array(np.diff(np.append(cut, len(word))))], ["word", "pair", "c"])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.forget()
        m = known.value[2]
        step = max(500, CELLS // total)
        word, pair, c = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out(word, pair, c):
            heads = np.concatenate([[True], word[1:] != word[:-1]])
            place, words = np.cumsum(heads) - 1, word[heads]
            times = np.bincount(place, c, len(words)).astype(np.int64)
            cls = np.full(len(words), total - 2)
            often = times >= SEEN
            if often.any():
                use = often[place]
                cls[often] = gains((np.cumsum(often) - 1)[place[use]], pair[use], c[use], m).argmax(axis=1)
            return pa.RecordBatch.from_arrays([pa.array(words), pa.array(times), pa.array(cls.astype(np.int32))], ["word", "c", "class"])

        for batch in batches:
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                word, pair, c = (np.concatenate([x, part.column(i).to_numpy().astype(np.int64)]) for i, x in enumerate((word, pair, c)))
                last = int(np.searchsorted(word, word[-1]))  # the last word may go on in the next rows
                if last:
                    yield out(word[:last], pair[:last], c[:last])
                    word, pair, c = word[last:], pair[last:], c[last:]
                if len(word) > 100_000:  # one word so far: as many rows as pairs of classes at most
                    pair, c = _sum([pair], [c])
                    word = word[: len(pair)]
        if len(word):
            yield out(word, pair, c)

    found = rows.filter("not held_out").select("text").mapInArrow(contexts, "word long, pair int, c long")
    return found.repartition("word").sortWithinPartitions("word").mapInArrow(assign, "word long, c long, class int")


def vocabulary(rows: DataFrame) -> tuple[DataFrame, dict]:
    """The distributed table ``word, c, class`` of all but the clustered words, and what workers need, of fixed size."""
    sc = rows.sparkSession.sparkContext
    counts = stored(_unigrams(rows), "unigrams")
    often = (F.col("word") != 0) & (F.col("c") >= SEEN)
    whole = counts.agg(F.count_if(often).alias("often"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("word") == 0, F.col("c"))), F.lit(0)).alias("ends")).first()
    classes, moved = sizes(whole.often)
    top = counts.filter(often).orderBy(F.desc("c"), "word").limit(min(HEAD, moved)).toArrow()
    core, core_c = top.column("word").to_numpy().view(np.uint64), top.column("c").to_numpy().astype(np.int64)
    bigrams = _bigrams(rows, sc.broadcast(core))
    classes = max(1, min(classes, len(core)))
    of = exchange(bigrams, classes, ROUNDS)
    member = np.zeros((len(of), classes + 2))
    member[np.arange(len(of)), of] = 1
    table = stored(_classes(rows, core, of, member.T @ bigrams @ member), "classes")
    size, kinds = np.bincount(of[: len(core)], core_c, classes + 1).astype(np.int64), 0
    for r in table.groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        size[r["class"]] += r.n
        kinds = r.v if r["class"] == classes else kinds
    more = table.orderBy(F.desc("c"), "word").limit(HEAD - len(core)).toArrow()
    head = np.concatenate([core, more.column("word").to_numpy().view(np.uint64)])
    c = np.concatenate([core_c, more.column("c").to_numpy().astype(np.int64)])
    cls = np.concatenate([of[: len(core)], more.column("class").to_numpy().astype(np.int64)])
    share = np.log10(np.append(np.maximum(size[:classes], 1), size[classes] + kinds + 1.0))
    order = np.argsort(head)
    model = {
        "n": int(whole.n),
        "v": int(whole.v),
        "ends": int(whole.ends),
        "head": head[order],
        "count": c[order],
        "class": cls[order],
        "emission": (np.log10(c + (cls == classes)) - share[cls])[order],
        "share": share,
        "unseen": -share[classes],
        "other": classes,
    }
    return table, model


def _flat(sequences: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Classes in a binary column, two bytes each, and the borders between rows."""
    _, edge, data = sequences.buffers()
    edge = np.frombuffer(edge, np.int32)[sequences.offset : sequences.offset + len(sequences) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[edge[0] : edge[-1]].view(np.uint16), (edge - edge[0]) // 2


def _binary(flat: np.ndarray, border: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(border) - 1, [None, pa.py_buffer((2 * border).astype(np.int32)), pa.py_buffer(flat.astype(np.uint16))])


_TAGGED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, emit double, classes binary, rare array<long>, place array<int>"


def tagged(rows: DataFrame, table: DataFrame, model: dict) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, base, emit, classes``: of every document the add-one score, log10 of its
    words' emissions, and two bytes for each token that name its class."""
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast(model)
    other = model["other"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        number = TaskContext.get().partitionId() << 36
        per_token = np.log10(m["n"] + m["v"] + 1.0)
        for batch in batches:
            for chunk in W.chunks(batch.column(2), lower=True):
                tokens, border = _tokens(chunk)
                at, known = W.find(m["head"], tokens)
                end = tokens == END
                rare = np.flatnonzero(~known & ~end)
                if len(m["head"]):
                    c, of = np.where(known, m["count"][at], 0), np.where(known, m["class"][at], OPEN)
                else:
                    c, of = np.zeros(len(tokens), np.int64), np.full(len(tokens), OPEN)
                c[end], of[end] = m["ends"], other + 1
                emit = np.where(known, m["emission"][at], 0.0) if len(m["head"]) else np.zeros(len(tokens))
                total = W.per_doc(np.stack([np.log10(c + 1.0) - per_token, emit], axis=1), border)
                seen = W.per_doc((c > 0).astype(np.int64), border)
                doc = np.searchsorted(border, rare, "right") - 1
                edge = pa.array(np.searchsorted(doc, np.arange(chunk.n + 1)).astype(np.int32))
                ids = number + np.arange(chunk.n)
                number += chunk.n
                part = batch.slice(chunk.first, chunk.n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), part.column(0), part.column(1), pa.array(np.diff(border)), pa.array(seen), pa.array(total[:, 0]), pa.array(total[:, 1]), _binary(of, border), pa.ListArray.from_arrays(edge, pa.array(tokens[rare].view(np.int64))), pa.ListArray.from_arrays(edge, pa.array((rare - border[doc]).astype(np.int32)))],
                    [x.split()[0] for x in _TAGGED.split(", ")],
                )

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, border = _flat(batch.column("classes"))
            flat = flat.copy()
            for name in ("found", "place"):
                if batch.column(name).null_count == len(batch):
                    break
            else:
                place = batch.column("place")
                row = np.repeat(np.arange(len(batch)), np.nan_to_num(place.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
                flat[border[row] + place.flatten().to_numpy()] = batch.column("found").flatten().to_numpy()
            flat[flat == OPEN] = other
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], _binary(flat, border)], batch.schema.names[:7])

    first = stored(rows.mapInArrow(run, _TAGGED), "tagged")
    rare = first.select("row", F.explode(F.arrays_zip("rare", "place")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.place").alias("place"))
    share = F.element_at(F.array(*[F.lit(float(x)) for x in model["share"]]), F.col("class") + 1)
    emit = F.log10(F.col("c") + F.when(F.col("class") == other, 1.0).otherwise(0.0)) - share
    found = rare.join(table, "word").groupBy("row").agg(F.count("*").alias("seen"), F.sum(F.log10(F.col("c") + 1.0)).alias("more"), F.sum(emit).alias("emitted"), F.collect_list(F.struct("class", "place")).alias("x"))
    out = first.withColumn("n_rare", F.size("rare")).drop("rare", "place").join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base"),
        (F.col("emit") + F.coalesce("emitted", F.lit(0.0)) + (F.col("n_rare") - F.coalesce("seen", F.lit(0))) * float(model["unseen"])).alias("emit"), "classes", F.col("x.class").alias("found"), F.col("x.place").alias("place"),
    )
    return stored(out.mapInArrow(fill, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, emit double, classes binary"), "filled")


def _pairs(docs: DataFrame, total: int) -> np.ndarray:
    """Counts of (class, next class) in all training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(total * total, np.int64)
        for batch in batches:
            if not len(batch):
                continue
            flat, _ = _flat(batch.column(0))
            flat = flat.astype(np.int64)
            out += np.bincount(np.concatenate([[total - 1], flat[:-1]]) * total + flat, minlength=total * total)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], ["pair", "c"])

    found = docs.filter("not held_out").select("classes").mapInArrow(run, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(total * total)
    out[found.column("pair").to_numpy()] = found.column("c").to_numpy()
    return out.reshape(total, total)


def fit(rows: DataFrame) -> tuple[DataFrame, dict]:
    """All documents with the classes of their tokens, as in :func:`tagged`, and the model."""
    table, model = vocabulary(rows)
    filled = tagged(rows, table, model)
    total = model["other"] + 2
    return filled, model | {"step": transitions(_pairs(filled, total), np.arange(total), model["other"])}


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score (the class model), both
    log10 probabilities, and perplexity (of the class model, per token) of every document."""
    filled, model = fit(_rows(docs))
    shared = docs.sparkSession.sparkContext.broadcast(model["step"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = shared.value
        for batch in batches:
            if len(batch):
                flat, border = _flat(batch.column(6))
                before = np.concatenate([np.full(1, len(step) - 1, np.uint16), flat[:-1]])
                total = batch.column(5).to_numpy() + W.per_doc(step[before, flat], border)
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(total)], batch.schema.names[:6])

    out = filled.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, emit double")
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model["n"]).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), F.col("emit").alias("score"), F.pow(F.lit(10.0), -F.col("emit") / F.col("n_tokens")).alias("perplexity"),
    )
