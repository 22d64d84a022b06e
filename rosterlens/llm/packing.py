"""Documents packed into fixed windows by order-preserving dynamic programming.

Each partition is one stream: its documents in their order, as token ids, each followed by an end id. The
stream is cut into windows of at most `size` tokens. A cut costs the padding of its window and a penalty: none
at the end of a document, `sentence_cost` at the end of a sentence, `word_cost` at one of the places set
every `gap` tokens where no sentence ends. The cheapest cuts come from dynamic programming over all these
places; a window's best start is the least of (cost + position) among the places within reach, which a
monotone queue holds, so each place is entered and left once. The stream is solved in blocks; the last window of a block is
not cut but opens the next block. Documents are neither moved nor collected: a partition is packed where it is.

Token ids are those of the whole text: pre-tokens of this vocabulary begin at each space, so the distinct words of a
batch are encoded alone and kept by the worker, in tables of a bounded size; texts where that does not hold (runs of white
space, special strings) are encoded whole.

Defined results: a null or empty text is its end id alone. Rows are independent documents, so repeats and
null ids are packed like any other. An empty table gives no rows. Ids of sequences are unique within the
result. Columns besides id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from rosterlens.llm.common import slices

SENTENCE = (".", "!", "?")
SPACE, NEWLINE = "Ġ", "Ċ"  # how the vocabulary spells them
KEPT = 200_000  # words that a worker keeps, before a batch adds its own
LONGEST = 64  # characters of a word that is kept; texts with longer ones are encoded whole
BATCH_BYTES = 2 << 20
LETTER = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]"
LETTER_WORDS = "letters"
MARK = "\x01"  # before signs that follow a letter; texts that hold one are encoded whole
LETTER_SIGN = f"({LETTER})([.,!?;:%*#&$|])"


@cache
def tokenizer(name: str) -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path(name))


class WordIds:
    """Ids of words, as little-endian bytes, after a space (lead " ") or after nothing (lead "")."""

    def __init__(self, name: str):
        self.tokenizer = tokenizer(name)
        self.newline = self.whole("\n")
        specials = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = "|".join([*specials, MARK])
        # A word of letters after a space is one pre-token: only the model and its alphabet are needed.
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.CharDelimiterSplit("\n"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        names = map(self.tokenizer.id_to_token, range(self.tokenizer.get_vocab_size()))
        self.begins = np.array([(t or "").startswith(SPACE) for t in names])
        self.tables: dict[str, dict[str, bytes]] = {LETTER_WORDS: {}, " ": {}, "": {}}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, kind: str, words: list[str]) -> list[bytes | None]:
        """Ids of distinct words of a kind: after a space, LETTER_WORDS or others, or after nothing.

        They are kept in tables that begin anew once they have KEPT words. None for words over LONGEST characters and for those
        whose ids depend on their surroundings: empty ones, as between two spaces, and those with other white space.
        """
        if sum(map(len, self.tables.values())) > KEPT:
            self.tables = {kind: {} for kind in self.tables}
        table = self.tables[kind]
        found = list(map(table.get, words))
        new = [w for w, ids in zip(words, found) if ids is None and len(w) <= LONGEST]
        if kind != LETTER_WORDS:
            new = [w for w in new if w.split() == [w]]
        if not new:
            return found
        encoded = self._encoded_letters(new) if kind == LETTER_WORDS else self._encoded(kind, new)
        table.update(zip(new, encoded, strict=True))
        return list(map(table.get, words))

    def _encoded(self, lead: str, words: list[str]) -> Iterator[bytes]:
        """One call for many words: a newline between them is a token that no word has."""
        for i in range(0, len(words), 20_000):
            joined = f"\n{lead}" + f"\n{lead}".join(words[i : i + 20_000])
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            data = ids.tobytes()
            cut = [*(4 * np.flatnonzero(ids == np.frombuffer(self.newline, "<u4"))).tolist(), len(data)]
            yield from (data[a + 4 : b] for a, b in zip(cut[:-1], cut[1:]))

    def _encoded_letters(self, words: list[str]) -> Iterator[bytes]:
        """The same for words of letters after a space, whose first token shows that it begins a word."""
        for i in range(0, len(words), 20_000):
            joined = " " + "\n ".join(words[i : i + 20_000])
            ids = np.array(self.letters.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            data = ids.tobytes()
            cut = [*(4 * np.flatnonzero(self.begins[ids])).tolist(), len(data)]
            yield from (data[a:b] for a, b in zip(cut[:-1], cut[1:]))


class TextEncoder:
    """Ids of texts, and the token positions where their sentences end."""

    def __init__(self, name: str):
        self.words = WordIds(name)
        tokens = [tokenizer(name).id_to_token(i) or "" for i in range(tokenizer(name).get_vocab_size())]
        self.stops = np.array([t.endswith(SENTENCE) for t in tokens])
        self.opens = np.array([t.startswith((SPACE, NEWLINE)) for t in tokens])
        self.breaks = np.array([t.startswith(NEWLINE) for t in tokens])

    def ends(self, at: np.ndarray) -> np.ndarray:
        """Before each space that follows a stop, and before each newline."""
        return np.flatnonzero((self.stops[at[:-1]] & self.opens[at[1:]]) | self.breaks[at[1:]]) + 1

    def __call__(self, texts: list[str] | pa.Array) -> Iterator[tuple[bytes, np.ndarray]]:
        """The distinct words of all texts are looked up once, and their ids laid out in the order of the texts."""
        texts = pa.array(texts, pa.string())
        if not len(texts):
            return
        odd = pc.match_substring_regex(texts, self.words.special)
        # A newline is a word of its own, and so are signs after a letter, marked, as they are pre-tokens of their own.
        plain = pc.replace_substring_regex(pc.if_else(odd, "", texts), LETTER_SIGN, rf"\1 {MARK}\2")
        split = pc.split_pattern(pc.replace_substring(plain, "\n", " \n "), " ")
        coded = split.flatten().dictionary_encode()
        distinct, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        words = distinct.to_numpy(zero_copy_only=False)
        lasts = np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
        # What begins a text or a line, or is marked, has no space before it.
        bare = np.zeros(len(codes), bool)
        bare[np.concatenate(([0], lasts[:-1]))] = True
        newline = pc.equal(distinct, "\n").to_numpy(zero_copy_only=False)
        bare[1:] |= newline[codes[:-1]]
        place = codes + len(words) * bare.astype(np.int32)
        used = np.zeros(2 * len(words), bool)
        used[place] = True
        later, first = used[: len(words)], used[len(words) :]
        letters = pc.match_substring_regex(distinct, f"^{LETTER}+$").to_numpy(zero_copy_only=False) & later
        marked = pc.starts_with(distinct, MARK).to_numpy(zero_copy_only=False)
        kinds = [
            (LETTER_WORDS, letters), (" ", later & ~(letters | marked | newline)), ("", first & ~marked),
            ("", marked), (None, newline),
        ]
        found, inverse, n = [], np.empty(len(used), np.int32), 0
        for kind, mask in kinds:
            at = np.flatnonzero(mask)
            asked = words[at].tolist()
            if mask is marked:
                asked = [w[1:] for w in asked]
            found += self.words.of(kind, asked) if kind is not None else [self.words.newline] * len(asked)
            inverse[at + len(words) * (mask is kinds[2][1])] = np.arange(n, n + len(asked))
            n += len(asked)
        place = inverse[place]
        # Texts with a word that cannot be encoded alone, or a special string.
        whole = odd.to_numpy(zero_copy_only=False).copy()
        bad = np.array([ids is None for ids in found])
        if bad.any():
            whole[np.searchsorted(lasts, np.flatnonzero(bad[place]), "right")] = True
            found = [ids or b"" for ids in found]
        table = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start = np.cumsum(size) - size
        sizes = size[place]
        after = np.cumsum(sizes)
        at = np.repeat(start[place] - after + sizes, sizes)
        at += np.arange(len(at))
        flat = table[at]
        ends = self.ends(flat)
        cuts = np.concatenate(([0], after))[np.concatenate(([0], lasts))]
        first, last = np.searchsorted(ends, cuts[:-1], "right"), np.searchsorted(ends, cuts[1:])
        for i, (a, b, p, q) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), first.tolist(), last.tolist(), strict=True)):
            if whole[i]:
                ids = self.words.whole(texts[i].as_py())
                yield ids, self.ends(np.frombuffer(ids, "<u4"))
            else:
                yield flat[a:b].tobytes(), ends[p:q] - a


@cache
def encoder(name: str) -> TextEncoder:
    """One for all tasks of a worker, so that what it has learnt stays."""
    return TextEncoder(name)


def places(n: int, sentences: np.ndarray, gap: int, sentence_cost: int, word_cost: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a document of n tokens may be cut, and at what cost; its end costs nothing.

    `sentences` are positions of their ends, rising, without repeats.
    """
    inner = sentences[sentences < n]
    edges = np.concatenate(([0], inner, [n]))
    wide = np.flatnonzero(edges[1:] - edges[:-1] > gap)
    if not len(wide):
        return edges[1:], np.concatenate((np.full(len(inner), sentence_cost), [0]))
    filled = [np.arange(edges[i] + gap, edges[i + 1], gap) for i in wide.tolist()]
    at = np.concatenate([inner, *filled, [n]])
    cost = np.concatenate([
        np.full(len(inner), sentence_cost), np.full(sum(map(len, filled)), word_cost), [0]
    ])
    order = np.argsort(at, kind="stable")
    return at[order], cost[order]


def cheapest_cuts(at: list[int], cost: list[int], size: int) -> list[int]:
    """Indexes of the places to cut at, the last one included; the stream begins at 0."""
    least, came = [0] * (len(at) + 1), [0] * (len(at) + 1)  # place 0 is the beginning
    position = [0, *at]
    queue = deque([(0, 0)])  # (cost + position, place), both rising
    for j in range(1, len(position)):
        here = position[j]
        while position[queue[0][1]] < here - size:
            queue.popleft()
        best, i = queue[0]
        came[j] = i
        value = least[j] = best + size - here + cost[j - 1]
        value += here
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    cuts, j = [], len(at)
    while j:
        cuts.append(j - 1)
        j = came[j]
    return cuts[::-1]


class Stream:
    """Documents on their way into sequences: [id, tokens before, ids, tokens of the document]."""

    def __init__(self, size: int, first_sequence: int, with_ids: bool):
        self.size, self.sequence, self.with_ids = size, first_sequence, with_ids
        self.docs: deque = deque()
        self.at: list[np.ndarray] = []
        self.cost: list[np.ndarray] = []
        self.length = 0

    def add(self, key, ids: bytes, at: np.ndarray, cost: np.ndarray) -> None:
        self.docs.append([key, 0, ids, len(ids) // 4])
        self.at.append(at + self.length)
        self.cost.append(cost)
        self.length += len(ids) // 4

    def flush(self, last: bool) -> Iterator[tuple]:
        """Pieces of the finished sequences; unless `last`, the last window stays in the stream."""
        if not self.length:
            return
        at, cost = np.concatenate(self.at), np.concatenate(self.cost)
        cuts = cheapest_cuts(at.tolist(), cost.tolist(), self.size)
        if not last:
            cuts.pop()
        begin = 0
        for cut in cuts:
            yield from self._sequence(int(at[cut]) - begin)
            begin = int(at[cut])
        rest = at > begin
        self.at, self.cost, self.length = [at[rest] - begin], [cost[rest]], self.length - begin

    def _sequence(self, length: int) -> Iterator[tuple]:
        offset = 0
        while offset < length:
            key, start, ids, total = self.docs[0]
            n = min(total - start, length - offset)
            piece = ids[4 * start : 4 * (start + n)]
            yield (
                key, start, n, zlib.crc32(piece), total, self.sequence, offset,
                np.frombuffer(piece, "<i4") if self.with_ids else None,
            )
            offset += n
            if start + n == total:
                self.docs.popleft()
            else:
                self.docs[0][1] += n
        self.sequence += 1


FIELDS = [
    ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32())),
]


def packed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json",
    size: int = 2048, end_id: int = 1, sentence_cost: int = 8, word_cost: int = 32, gap: int = 128,
    block_tokens: int = 1 << 20, with_ids: bool = True,
) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids) of every piece."""
    gap = min(gap, max(size // 16, 1))  # no place is out of reach

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        stream = Stream(size, TaskContext.get().partitionId() << 33, with_ids)
        schema = None

        def rows(last: bool) -> Iterator[pa.RecordBatch]:
            out = list(stream.flush(last))
            if out:
                yield pa.record_batch(list(map(list, zip(*out))), schema=schema)

        for batch in slices(batches, "text", most_bytes=BATCH_BYTES):
            schema = schema or pa.schema([("id", batch.schema.field("id").type), *FIELDS])
            texts = pc.fill_null(batch.column("text"), "")
            for key, (ids, sentences) in zip(batch.column("id").to_pylist(), encode(texts)):
                ids += end
                stream.add(key, ids, *places(len(ids) // 4, sentences, gap, sentence_cost, word_cost))
                if stream.length > block_tokens:
                    yield from rows(False)
        yield from rows(True)

    cols = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = cols.schema["id"].dataType.simpleString()
    return cols.mapInArrow(
        run,
        f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>",
    )
