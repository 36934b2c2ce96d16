"""Packing token streams into sequences of bounded length by an order-preserving dynamic programme."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verba.llm.common import worker_cache

SENTENCE_CUT = 8  # a cut after a sentence inside a document costs as much as so much padding
HARD_CUT = 64  # a cut elsewhere; such cuts are offered where no boundary comes for so many tokens
CHUNK = 1 << 18  # tokens that one programme looks at
CACHE = 1_200_000  # words whose ids a worker remembers
PIECE = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def word_encoder(path: str):
    """(encode, ends): encode maps texts as bytes to little-endian 32-bit ids as bytes, as the tokenizer
    file gives them; ends is a boolean per id, true where it closes a sentence.

    The vocabulary drops white space and never joins across it, so words are encoded one by one and
    remembered. A-Z are lowered first, as its normalizer does, where that commutes with composition and
    special tokens; a run of sentence marks after a letter or digit is a word of its own to it."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from array import array

    import numpy as np
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    known: dict[bytes, bytes] = {}
    ends = np.zeros(tok.get_vocab_size(), dtype=bool)
    for word, i in tok.get_vocab().items():
        body = word.removesuffix("</w>")
        if body != word and body and body[-1] in ".!?" and not any(c.isalnum() for c in body):
            ends[i] = True

    def learn(words):
        for w, e in zip(words, tok.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False),
                        strict=True):
            known[w] = array("I", e.ids).tobytes()

    def encode(texts):
        split = [(t if b"<|" in t or b"\xcc" in t or b"\xcd" in t else t.lower()).split() for t in texts]
        if len(known) > CACHE:
            known.clear()
        new = set().union(*split).difference(known)
        if new:
            whole, parts = set(), {}
            for w in new:
                core = w.rstrip(b".,!?;:")
                if core and len(core) < len(w) and core[-1:].isalnum():
                    parts[w] = (core, w[len(core):])
                    whole.update(parts[w])
                else:
                    whole.add(w)
            learn(list(whole.difference(known)))
            for w, (core, marks) in parts.items():
                known[w] = known[core] + known[marks]
        return [b"".join(map(known.__getitem__, words)) for words in split]

    return encode, ends


def best_cuts(ends, doc_ends, size: int):
    """Cuts of a token stream into windows of at most ``size``: positions, the last one the stream's end.

    ends: a boolean per token, true after a sentence; doc_ends: sorted positions after each document.
    The cost of a window is its padding and, unless it ends with a document, the price of its cut:
    f(k) = min f(j) + size - (c[k] - c[j]) + price(k) over the candidates j within size. f(j) + c[j]
    is kept in a queue of rising values, so every candidate enters and leaves once."""
    from collections import deque

    import numpy as np

    total = len(ends)
    price = np.full(total + 1, -1, dtype=np.int64)
    price[np.flatnonzero(ends) + 1] = SENTENCE_CUT
    price[doc_ends] = 0
    price[0] = price[total] = 0
    c = np.flatnonzero(price >= 0)
    gaps = np.flatnonzero(np.diff(c) > HARD_CUT)
    if len(gaps):
        more = np.concatenate([np.arange(c[g] + HARD_CUT, c[g + 1], HARD_CUT) for g in gaps])
        price[more] = HARD_CUT
        c = np.flatnonzero(price >= 0)
    cost, c = price[c].tolist(), c.tolist()
    back = [0] * len(c)
    queue = deque([(0, 0, 0)])  # f + position, position, index
    for k in range(1, len(c)):
        at = c[k]
        while queue[0][1] < at - size:
            queue.popleft()
        low, _, back[k] = queue[0]
        low += size + cost[k]  # f(k) + position
        while queue and queue[-1][0] >= low:
            queue.pop()
        queue.append((low, at, k))
    cuts, k = [], len(c) - 1
    while k:
        cuts.append(c[k])
        k = back[k]
    return cuts[::-1]


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048,
         end_id: int = 1) -> DataFrame:
    """Pieces of documents in sequences of at most ``size`` tokens: the id, start (tokens of its document
    before it), length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id and offset.

    A document is its text's ids and ``end_id``. Each input partition keeps its order and is cut on its
    own, as a stream, CHUNK tokens at a time: the last window of a chunk opens the next one, so a task
    holds some chunks and no more, and no group of rows meets anywhere. sequence_id is the partition's
    number times 2**40 plus a count. The input should come from files or tables, so that a lost task
    packs the same rows in the same order again. Null and empty texts are one end_id. Ids may be null
    or repeat: each row is a document. Very long texts are cut like any other. Empty table: no rows."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches, vocabulary=vocabulary, size=size, end_id=end_id):
        import numpy as np
        import pandas as pd
        from pyspark import TaskContext

        encode, is_end = worker_cache(f"words:{vocabulary}", lambda: word_encoder(vocabulary))
        close = np.uint32(end_id).tobytes()
        sequence = TaskContext.get().partitionId() << 40
        ids, held, done = [], [], 0  # documents not yet packed; tokens of the first that are

        def rows(last):
            nonlocal ids, held, done, sequence
            size_of = np.array([len(h) // 4 for h in held], dtype=np.int64)
            data = np.frombuffer(b"".join(held), dtype="<u4")[done:]
            doc_end = np.cumsum(size_of) - done
            cuts = best_cuts(is_end[data], doc_end, size)
            if not last:
                cuts.pop()  # it may still be filled
            stop = cuts[-1] if cuts else 0
            if stop:
                edge = np.unique(np.concatenate([[0], cuts, doc_end[doc_end < stop]]))
                a, b = edge[:-1], edge[1:]
                doc = np.searchsorted(doc_end, a, side="right")
                seq = np.searchsorted(cuts, a, side="right")
                begin = np.concatenate([[0], cuts])[seq]
                raw = data.tobytes()
                yield pd.DataFrame({
                    "id": pd.Series([ids[d] for d in doc], dtype=object),
                    "start": a - (doc_end[doc] - size_of[doc]), "length": b - a,
                    "ids": [raw[4 * x: 4 * y] for x, y in zip(a.tolist(), b.tolist(), strict=True)],
                    "doc_tokens": size_of[doc], "sequence_id": sequence + seq, "offset": a - begin})
                sequence += len(cuts)
            first = int(np.searchsorted(doc_end, stop, side="right"))  # the first document that goes on
            done = int(stop - (doc_end[first] - size_of[first])) if first < len(held) else 0
            ids, held = ids[first:], held[first:]

        tokens = 0
        for part in batches:
            texts, keys = part["t"].tolist(), part["id"].tolist()
            for lo in range(0, len(texts), 256):
                new = encode([t or b"" for t in texts[lo: lo + 256]])
                for key, e in zip(keys[lo: lo + 256], new, strict=True):
                    ids.append(key)
                    held.append(e + close)
                    tokens += len(e) // 4 + 1
                    if tokens >= CHUNK:
                        yield from rows(False)
                        tokens = sum(len(h) // 4 for h in held) - done
        if held:
            yield from rows(True)

    src = docs.select(docs[f"`{id_col}`"].cast("string").alias("id"), docs[f"`{text_col}`"].cast("binary").alias("t"))
    out = src.mapInPandas(run, f"id string, {PIECE}")
    return out.select(F.col("id").cast(kind).alias(id_col), "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


def sequences(pieces: DataFrame) -> DataFrame:
    """Pieces -> (sequence_id, ids): the sequences themselves. A sequence holds at most its size in tokens."""
    return pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p")).select(
        "sequence_id", F.expr("concat(aggregate(p, X'', (a, x) -> concat(a, x.ids)))").alias("ids"))
