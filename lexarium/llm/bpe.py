"""BPE encoding and decoding by prefix-sharing trie traversal.

Of each block of documents the distinct words that are not yet known go into a trie. Walking it depth first, each node
(a prefix) gets the last token of its encoding; this token and the state of the node it leaves over give the whole
encoding, so what words share is encoded once. A token may follow another exactly if the pair is its own encoding,
which is found by plain merging once for each pair. The trie is kept as the sorted list of its words: consecutive words
share the path of their common prefix, which is the stack of the walk. Beside its last token a node has the longest of its
endings that begins a token; this ending and the next letter give the tokens the next node may end in. Cost is linear in a
word's length. What happens to each occurrence of a word, not to each distinct one, is left to Arrow's kernels.
"""

from __future__ import annotations

import json
import unicodedata
import uuid
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import accumulate, chain, count, repeat
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import types as T

if TYPE_CHECKING:
    import numpy as np
    import pyarrow as pa

#: Characters that Python's str.split() takes for white space and Unicode does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Words of a word-level tokenizer; the pattern of the public CLIP-style vocabularies, stated in their files.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
#: Words whose encodings a worker keeps; bounds its memory.
CACHE_ENTRIES = 700_000
#: Bytes of text that are encoded together, but for single texts that are longer.
BLOCK_BYTES = 8 << 20
_TOKENIZERS: dict[tuple[str, str], WordTokenizer] = {}


@cache
def byte_letters() -> list[str]:
    """The letter for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class TrieEncoder:
    """Encodes words, given as strings of byte letters, with a vocabulary and its merges in order."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], word_end: str = ""):
        self.vocabulary, self.word_end = vocabulary, word_end
        self.ranks = {pair: i for i, pair in enumerate(merges)}
        self._follows: dict[tuple[str, str], bool] = {}
        self._steps: dict[str, tuple[str, list[tuple[str, int]]]] = {}
        self._ends: dict[str, list[tuple[str, int]]] = {}
        cores = [t.removesuffix(word_end) if word_end and len(t) > len(word_end) else t for t in vocabulary]
        self.beginnings = {c[:i] for c in cores for i in range(1, len(c) + 1)}

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE: the merge of lowest rank first, the leftmost of equals."""
        symbols, none = list(symbols), 1 << 60
        while len(symbols) > 1:
            ranks = list(map(self.ranks.get, zip(symbols, symbols[1:], strict=False), repeat(none)))
            rank = min(ranks)
            if rank == none:
                break
            i = ranks.index(rank)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def symbols(self, token: str) -> list[str]:
        """The symbols a token is merged from."""
        if self.word_end and token.endswith(self.word_end) and len(token) > len(self.word_end):
            core = token[: -len(self.word_end)]
            return [*core[:-1], core[-1] + self.word_end]
        return [*token]

    def follows(self, first: str, second: str) -> bool:
        """Whether the two tokens in this order are the encoding of what they spell."""
        pair = (first, second)
        known = self._follows.get(pair)
        if known is None:
            if len(self._follows) > 1_000_000:
                self._follows.clear()
            known = self._follows[pair] = self.merged(self.symbols(first) + self.symbols(second)) == [first, second]
        return known

    def _step(self, path: str) -> tuple[str, list[tuple[str, int]]]:
        """Of a node's ending and the next letter: the longest ending that begins a token, and the tokens they end in, longest first, with lengths."""
        if len(self._steps) > 1_000_000:
            self._steps.clear()
        endings = [path[i:] for i in range(len(path))]
        begun = next((e for e in endings if e in self.beginnings), "")
        self._steps[path] = step = (begun, [(e, len(e)) for e in endings if e in self.vocabulary])
        return step

    def _end(self, path: str) -> list[tuple[str, int]]:
        """The same tokens where the word ends."""
        if len(self._ends) > 1_000_000:
            self._ends.clear()
        self._ends[path] = ends = [(path[i:] + self.word_end, len(path) - i) for i in range(len(path)) if path[i:] + self.word_end in self.vocabulary]
        return ends

    def _last(self, tokens: list[tuple[str, int]], states: list[str]) -> str:
        """The last token of a prefix, from those it may end in and the states of the shorter prefixes."""
        follows = self._follows
        for token, length in tokens:
            first = states[-length]
            if not first:
                return token
            known = follows.get((first, token))
            if self.follows(first, token) if known is None else known:
                return token
        raise ValueError("no token ends a word: the vocabulary lacks a byte")

    def walk(self, words: Iterable[str]) -> Iterator[tuple[str, list[str]]]:
        """The distinct words in order, each with its tokens from the last to the first."""
        # For each node on the path its last token, and its longest ending that begins a token.
        states, begun, before, end = [""], [""], "", len(self.word_end)
        steps, ends, follows, last = self._steps, self._ends, self._follows, self._last
        for word in sorted(set(words)):
            if not word:
                yield word, []
                continue
            shared, most = 0, min(len(states) - 1, len(word) - 1)
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del states[shared + 1 :], begun[shared + 1 :]
            ending = begun[-1]
            for letter in word[shared:-1]:
                path = ending + letter
                ending, tokens = steps.get(path) or self._step(path)
                token, length = tokens[0] if tokens else ("", 1)
                first = states[-length]
                # Mostly the longest token; if it can't stand there, the next.
                states.append(token if token and (not first or follows.get((first, token))) else last(tokens, states))
                begun.append(ending)
            path = ending + word[-1]
            token = last(ends.get(path) or self._end(path), states)
            found, at = [token], len(word) - len(token) + end
            while at:
                token = states[at]
                found.append(token)
                at -= len(token)
            yield word, found
            before = word

    def encode(self, words: Iterable[str]) -> dict[str, list[str]]:
        """The tokens of each distinct word."""
        return {word: tokens[::-1] for word, tokens in self.walk(words)}


class Letters(dict):
    """For str.translate: the byte letters of a character's UTF-8; line feeds stay."""

    def __missing__(self, code: int) -> str:
        letters = byte_letters()
        self[code] = out = "\n" if code == 10 else "".join([letters[b] for b in chr(code).encode()])
        return out


class WordTokenizer:
    """A word-level BPE tokenizer read from a `tokenizers` JSON file: NFC, lower case, words, byte letters, word ends."""

    def __init__(self, definition: str):
        import pyarrow as pa
        import regex

        spec = json.loads(definition)
        model = spec["model"]
        self.vocabulary = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.encoder = TrieEncoder(self.vocabulary, merges, model["end_of_word_suffix"] or "")
        names = {i: t for t, i in chain(self.vocabulary.items(), self.added.items())}
        self.spelled = pa.array([" " + names.get(i, "") for i in range(max(names) + 1)], pa.large_string())
        self.words = regex.compile(WORD_PATTERN).findall
        self.lines = regex.compile(r"\n|" + WORD_PATTERN).findall
        self.letters = Letters()
        self.pieces = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")").split
        self.spaces = regex.compile(r"\p{White_Space}+").split
        self.known: dict[str | int, bytes] = {}

    def _words(self, chunk: str) -> list[str | int]:
        """The words of a chunk; an added token as its id."""
        if "<|" in chunk:
            pieces = self.pieces(chunk)
            if len(pieces) > 1:
                return [x for p in pieces if p for x in ([self.added[p]] if p in self.added else self._words(p))]
        return self._split(self.folded(chunk))

    def odd(self, text: str) -> bool:
        """Whether a text may hold added tokens or has letters beyond U+FFFF."""
        return "<|" in text or not text.isascii() and len(text.encode("utf-16-le")) > 2 * len(text)

    def folded(self, text: str) -> str:
        """NFC, lower case; each letter alone: no final sigma."""
        return (text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")).lower()

    def _split(self, chunk: str) -> list[str]:
        """Words by the pattern; beyond U+FFFF by the standard library's classes, since the pattern's take unassigned code points for letters."""
        if max(chunk, default="") < "\U00010000":
            return self.words(chunk)
        plain = "".join([c if c < "\U00010000" else "a" if c.isalpha() else "1" if unicodedata.category(c)[0] == "N" else "!" for c in chunk])
        ends = list(accumulate(map(len, self.words(plain))))
        return [chunk[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def chunks(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """What stands between white space, which no token crosses (strings may be empty), and where each text's chunks end."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        _, offsets, data = texts.buffers()
        first, *_, last = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1][[0, -1]].tolist()
        letters = np.frombuffer(data, np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)
        if (letters - np.uint8(ord(SEPARATORS[0])) < len(SEPARATORS)).any():
            lists = pa.array([self.spaces(t) for t in texts.to_pylist()], pa.large_list(pa.large_string()))
        else:
            lists = pc.utf8_split_whitespace(texts)
        return lists.offsets.to_numpy(), lists.flatten()

    def learn(self, words: Iterable[str | int]) -> None:
        """Encodes the distinct words that are not yet known, through their trie."""
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        known, vocabulary = self.known, self.vocabulary
        missing = [w for w in words if w not in known]
        known |= {i: array("i", [i]).tobytes() for i in missing if isinstance(i, int)}
        missing = [w for w in missing if isinstance(w, str)]
        if missing:
            words = dict(zip("\n".join(missing).translate(self.letters).split("\n"), missing, strict=True))
            for letters, tokens in self.encoder.walk(words):
                known[words[letters]] = array("i", [vocabulary[t] for t in reversed(tokens)]).tobytes()

    def encoded(self, chunks: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """The ids of distinct chunks as a list array, and the place there of each chunk."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        joined = pc.binary_join(pa.LargeListArray.from_arrays([0, len(chunks)], chunks), pa.scalar("\n", pa.large_string()))[0].as_py()
        folded, odd, places = self.folded(joined), [], np.arange(len(chunks))
        if self.odd(joined) or self.odd(folded):
            each = joined.split("\n")
            is_odd = np.array([self.odd(c) or self.odd(self.folded(c)) for c in each])
            odd = [c for c, o in zip(each, is_odd, strict=True) if o]
            folded = self.folded("\n".join([c for c, o in zip(each, is_odd, strict=True) if not o]))
            places = np.argsort(np.argsort(is_odd, kind="stable"))
        # The words of all chunks, a line feed behind those of each; odd chunks come last.
        words = self.lines(folded + "\n") if len(odd) < len(chunks) else []
        for c in odd:
            words += [*self._words(c), "\n"]
        index = dict(zip(dict.fromkeys(words), count()))
        at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        self.learn(w for w in index if w != "\n")
        known = self.known
        ids = [b"" if w == "\n" else known[w] for w in index]
        lists = pa.LargeListArray.from_arrays(pa.array(np.cumsum([0, *[len(i) // 4 for i in ids]])), pa.array(np.frombuffer(b"".join(ids), "<i4"))).take(pa.array(at))
        ends = lists.offsets.to_numpy()[1:][at == index["\n"]]
        return places, pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], ends])), lists.flatten())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (large strings without nulls), and where each text's begin and end."""
        import numpy as np
        import pyarrow as pa

        ends, chunks = self.chunks(texts)
        if not len(chunks):
            return np.zeros(0, "<i4"), np.zeros(len(texts) + 1, np.int64)
        chunks = chunks.dictionary_encode()
        places, lists = self.encoded(chunks.dictionary)
        found = lists.take(pa.array(places[chunks.indices.to_numpy()]))
        return found.flatten().to_numpy(), found.offsets.to_numpy()[ends]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of the ids between the ends; the file names no decoder: tokens joined by one space."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(ids):
            return pa.array([""] * (len(ends) - 1), pa.large_string())
        _, offsets, data = self.spelled.take(pa.array(ids)).buffers()
        begins = np.frombuffer(offsets, np.int64)[ends]
        return pc.utf8_slice_codeunits(pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(begins.tobytes()), data), 1)

    def block(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """The ids (little-endian 32-bit) and the decoded text of each text."""
        import pyarrow as pa

        ids, ends = self.encode(pa.array(texts, pa.large_string()))
        return [ids[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], self.decode(ids, ends).to_pylist()


def blocks(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where the blocks of BLOCK_BYTES begin and end; longer texts stand alone."""
    at = size = 0
    for i, length in enumerate(lengths.tolist()):
        if i > at and size + length > BLOCK_BYTES:
            yield at, i
            at, size = i, 0
        size += length
    if len(lengths):
        yield at, len(lengths)


def word_tokenizer(definition: str, job: str) -> WordTokenizer:
    """A worker's tokenizer for a job: what it has learned serves the next task of that job, and no other job."""
    if (definition, job) not in _TOKENIZERS:
        _TOKENIZERS.clear()  # before the next one is built: never two at once
        _TOKENIZERS[definition, job] = WordTokenizer(definition)
    return _TOKENIZERS[definition, job]


def bpe_encode(docs: DataFrame, tokenizer_path: str, text_column: str = "text") -> DataFrame:
    """docs with n_tokens (long), ids (array<int>) and decoded (string) in place of the text column.

    Each row's whole text is encoded as the file at tokenizer_path (read by the driver, a file of fixed size) says, without special
    tokens of its own, and the ids are decoded again. Null and empty texts have no ids and decode to the empty string.
    Columns of docs named n_tokens, ids or decoded are replaced. An empty table gives no rows; repeated rows repeat.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    job = uuid.uuid4().hex
    kept = [f for f in docs.schema.fields if f.name not in (text_column, "n_tokens", "ids", "decoded")]
    names = [f.name for f in kept]
    schema = docs.select(*[f"`{n}`" for n in names]).schema.add("n_tokens", "long").add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")

    def encode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        tokenizer = word_tokenizer(definition.value, job)
        for batch in batches:
            texts = pc.fill_null(batch.column(len(names)).cast(pa.large_string()), "")
            for at, end in blocks(pc.binary_length(texts).to_numpy()):
                part = batch.slice(at, end - at)
                ids, ends = tokenizer.encode(texts.slice(at, end - at))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                decoded = tokenizer.decode(ids, ends).cast(pa.string())
                columns = [part.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(ends)), lists, decoded], names=[*names, "n_tokens", "ids", "decoded"])

    return docs.select(*[f"`{n}`" for n in names], f"`{text_column}`").mapInArrow(encode, schema)
