"""BPE encoding by a transducer of bounded lookahead, decoding by a state machine.

Merges apply by rank, so a change at the right end of a string reaches to the left only by a
chain of merges of rising rank: after merge (u, v) took or left u, the next one back must
have a right part that starts with u, and moves the reach by its own left part. The longest
such chain is the merge list's sufficient lookahead. A token that ends that many symbols
before the end of what has been read can't change any more; the transducer emits it and
forgets its symbols, so it holds a constant number of symbols however long a word is.

Every word goes through the transducer. A text is read in pieces, cut at white space or, where
there is none, at a place that neither normalisation nor a pattern of words looks across; an
open word stays in its transducer from piece to piece. Ids leave as they are found, and go
straight into digests and decoders, so nothing grows with a text but the text itself.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import binary_texts, small_batches

END = ""  # added to the last symbol of a word while merging
MEMO = 250_000  # distinct chunks, and distinct words, that a worker remembers
BLOCK = 4096  # symbols that the transducer reads before it looks for stable tokens
PIECE = 1 << 16  # bytes of a text that are read at once
SHORT = 64  # characters of a word's part that waits for the next piece as text


def _byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


BYTE_CHARS = _byte_chars()
CHAR_BYTES = {c: b for b, c in enumerate(BYTE_CHARS)}


@dataclass(frozen=True)
class Vocabulary:
    """ids: by token. ranks: by pair of symbols. special: whole strings with ids of their own.
    word_end: the suffix of a word's last token. pattern: matches the words of a text."""

    ids: dict[str, int]
    ranks: dict[tuple[str, str], int]
    special: dict[str, int]
    word_end: str
    pattern: str
    lookahead: int
    path: str

    @property
    def pieces(self) -> list[str]:
        out = [""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for token, i in [*self.ids.items(), *self.special.items()]:
            out[i] = token
        return out


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Symbols to the right of a token that fix it, by the longest chain of merges (u, v) of
    rising rank in which each v starts with the u before it; its length is the sum of len(u).
    One pass from the last merge to the first; reach[p] is the longest chain that can follow
    a left part p."""
    reach: dict[str, int] = {}
    best = 0
    for u, v in reversed(merges):
        own = len(u) + reach.get(u, 0)
        best = max(best, own)
        for i in range(1, len(v) + 1):
            if reach.get(v[:i], 0) < own:
                reach[v[:i]] = own
    return best


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    """Read a tokenizer file with a BPE model: lower case, one word end, byte-level symbols."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    suffix = model["end_of_word_suffix"] or ""
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    mark = lambda s: s[: -len(suffix)] + END if suffix and s.endswith(suffix) else s
    # a marked symbol is one symbol: chains are measured without the mark
    lookahead = sufficient_lookahead([(u, mark(v).replace(END, "") or v) for u, v in pairs])
    split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
    return Vocabulary(
        model["vocab"],
        {p: i for i, p in reversed(list(enumerate(pairs)))},
        {x["content"]: x["id"] for x in spec["added_tokens"]},
        suffix,
        split["pattern"]["Regex"],
        lookahead,
        path,
    )


NEVER = 1 << 60


def merge(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Apply the merge of least rank, leftmost first, until none applies."""
    rank = ranks.get
    found = [rank(p, NEVER) for p in zip(symbols, symbols[1:], strict=False)]
    while len(found) > 64:  # a pass over all pairs for each rank
        least = min(found)
        if least == NEVER:
            return symbols
        out, i, last = [], 0, len(symbols) - 1
        while i <= last:
            if i < last and found[i] == least:
                out.append(symbols[i] + symbols[i + 1])
                i += 2
            else:
                out.append(symbols[i])
                i += 1
        symbols = out
        found = [rank(p, NEVER) for p in zip(symbols, symbols[1:], strict=False)]
    while found:  # one merge, then its two new pairs
        least = min(found)
        if least == NEVER:
            break
        i = found.index(least)
        symbols[i] += symbols.pop(i + 1)
        del found[i]
        if i:
            found[i - 1] = rank((symbols[i - 1], symbols[i]), NEVER)
        if i < len(found):
            found[i] = rank((symbols[i], symbols[i + 1]), NEVER)
    return symbols


_SPACES = b" \t\n\r\x0b\x0c"


def _byte_symbols(word: str) -> str:
    return "".join([BYTE_CHARS[b] for b in word.encode("utf-8", "surrogatepass")])


class Transducer:
    """Reads the symbols of one word piece by piece; holds at most the lookahead and a block."""

    def __init__(self, vocab: Vocabulary, block: int = BLOCK):
        self.vocab, self.block, self.held, self.peak = vocab, max(1, block), "", 0

    def feed(self, symbols: str) -> Iterator[int]:
        ids, keep = self.vocab.ids, self.vocab.lookahead
        for i in range(0, len(symbols), self.block):
            self.held += symbols[i : i + self.block]
            self.peak = max(self.peak, len(self.held))
            # one symbol is left over for finish(), which marks the word's end
            if len(self.held) <= 2 * keep + self.block:
                continue
            done, limit = 0, len(self.held) - keep - 1
            for token in merge(list(self.held), self.vocab.ranks):
                if done + len(token) > limit:
                    break
                done += len(token)
                yield ids[token]
            self.held = self.held[done:]

    def finish(self) -> list[int]:
        if not self.held:
            return []
        symbols = list(self.held)
        symbols[-1] += self.vocab.word_end
        self.held = ""
        return [self.vocab.ids[token] for token in merge(symbols, self.vocab.ranks)]


def normalise(text: str) -> str:
    """NFC, then lower case by single characters."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


@lru_cache(maxsize=1)
def _joining() -> frozenset:
    """Characters of combining class 0 that normalisation may join to the one before them."""
    out = {*map(chr, range(0x1161, 0x1176)), *map(chr, range(0x11A8, 0x11C3))}  # parts of Hangul syllables
    for c in range(0x110000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            out.add(chr(int(parts[1], 16)))
    return frozenset(out)


def _cut(text: str) -> int:
    """The last place from 1 on where a text can be cut before normalisation; 0 if none."""
    for i in range(len(text) - 1, 0, -1):
        c = text[i]
        if c < "\x80" or not unicodedata.combining(c) and c not in _joining():
            return i
    return 0


class Encoder:
    """Encodes texts piece by piece; remembers the ids of recent chunks and words, a chunk being
    what stands between white space, which no word spans."""

    def __init__(self, vocab: Vocabulary, memo: int = MEMO, piece: int = PIECE):
        self.vocab, self.limit, self.piece = vocab, memo, piece
        self.words: dict[str, bytes] = {}
        self.chunks: dict[bytes, bytes] = {}
        self.marks = [x.encode() for x in vocab.special]
        words = regex.compile(vocab.pattern)
        self.find, self.iterate = words.findall, words.finditer
        self.special = regex.compile(b"|".join(map(regex.escape, self.marks)) or rb"(?!)")
        self.more = {True: regex.compile(r"\p{L}+"), False: regex.compile(r"[^\s\p{L}\p{N}]+")}

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            run = Transducer(self.vocab)
            out = array("I", run.feed(word if word.isalpha() and word.isascii() else _byte_symbols(word)))
            out.extend(run.finish())
            found = out.tobytes()
            if len(word) <= SHORT:
                if len(self.words) >= self.limit:
                    self.words.clear()
                self.words[word] = found
        return found

    def _plain(self, raw: bytes) -> Iterator[bytes]:
        """The ids of a text without special tokens or ASCII white space, of any length."""
        if len(raw) <= self.piece:
            yield b"".join([self._word(w) for w in self.find(normalise(raw.decode("utf-8", "surrogatepass")))])
            return
        utf8 = codecs.getincrementaldecoder("utf-8")("surrogatepass")
        source = text = ""  # text read and not yet normalised; normalised and not yet encoded
        run, letters = None, False  # the transducer of a word that is still open
        for at in range(0, len(raw), self.piece):
            last = at + self.piece >= len(raw)
            source += utf8.decode(raw[at : at + self.piece], last)
            cut = len(source) if last else _cut(source)
            text, source = text + normalise(source[:cut]), source[cut:]
            done = 0
            if run and text:
                m = self.more[letters].match(text)
                done = m.end() if m else 0
                yield array("I", run.feed(_byte_symbols(text[:done]))).tobytes()
                if done < len(text) or last:
                    yield array("I", run.finish()).tobytes()
                    run = None
            for m in self.iterate(text, done):
                # a contraction has up to two characters after its sign
                if last or m.end() < len(text) and m.start() < len(text) - 2:
                    yield self._word(m[0])
                    done = m.end()
                    continue
                done = m.start()
                if len(m[0]) > SHORT:
                    run, done = Transducer(self.vocab), m.end()
                    letters = bool(self.more[True].match(m[0]))
                    yield array("I", run.feed(_byte_symbols(m[0]))).tobytes()
                break
            text = "" if last or run else text[done:]
        if run:
            yield array("I", run.finish()).tobytes()

    def _chunk(self, raw: bytes) -> Iterator[bytes]:
        at = 0
        for m in self.special.finditer(raw):
            yield from self._plain(raw[at : m.start()])
            yield array("I", [self.vocab.special[m[0].decode()]]).tobytes()
            at = m.end()
        yield from self._plain(raw[at:])

    def _short(self, raw: bytes) -> bytes:
        """The ids of a piece that starts and ends at white space or the text's ends."""
        low = raw.lower()  # A-Z alone; not where that could make a special token
        chunks = (raw if any(x.lower() in low for x in self.marks) else low).split()
        get = self.chunks.get
        out = list(map(get, chunks))
        if None in out:
            for i, found in enumerate(out):
                if found is None:
                    c = chunks[i]
                    if (found := get(c)) is None:
                        found = b"".join(self._chunk(c))
                        if len(c) <= SHORT:
                            if len(self.chunks) >= self.limit:
                                self.chunks.clear()
                            self.chunks[c] = found
                    out[i] = found
        return b"".join(out)

    def stream(self, raw: bytes) -> Iterator[bytes]:
        """The ids of a whole text in UTF-8, as little-endian unsigned 32-bit integers, in parts
        as they are found."""
        at, n = 0, len(raw)
        while at < n:
            end = min(n, at + self.piece)
            if end < n:
                end = max([raw.rfind(c, at, end) for c in _SPACES])
                if end <= at:  # no white space in the piece: up to the next one
                    end = min((x for c in _SPACES if (x := raw.find(c, at + 1)) >= 0), default=n)
                    yield from self._chunk(raw[at:end].strip(_SPACES))
                    at = end
                    continue
            yield self._short(raw[at:end])
            at = end

    def encode(self, raw: bytes) -> bytes:
        """All ids of a text at once."""
        return b"".join(self.stream(raw))


class Decoder:
    """Ids to text, piece by piece. "tokens" joins the tokens as the vocabulary writes them
    by spaces, as a tokenizer file without a decoder does; "text" gives the bytes' own text,
    with a space for each word end. The state is what a character still lacks."""

    def __init__(self, vocab: Vocabulary, form: str = "tokens"):
        self.form = form
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        self.reset()
        if form == "tokens":
            self.pieces = vocab.pieces
        else:
            end, special = vocab.word_end, set(vocab.special)
            self.pieces = [
                p.encode()
                if p in special
                else bytes(CHAR_BYTES[c] for c in (p.removesuffix(end) if end else p))
                + b" " * bool(end and p.endswith(end))
                for p in vocab.pieces
            ]

    def reset(self) -> None:
        """Ready for another text."""
        self.first = True
        self.utf8.reset()

    def feed(self, ids: Iterable[int]) -> str:
        found = map(self.pieces.__getitem__, ids)
        if self.form != "tokens":
            return self.utf8.decode(b"".join(found))
        text = " ".join(found)
        if not self.first and text:
            text = " " + text
        self.first = self.first and not text
        return text

    def finish(self) -> str:
        return "" if self.form == "tokens" else self.utf8.decode(b"", True)


@lru_cache(maxsize=2)
def worker_encoder(path: str) -> Encoder:
    """One encoder for each Python worker, kept between tasks."""
    return Encoder(load(path))


def _encode(key: str, text: str, path: str, keep_ids: bool):
    def run(batches):
        encoder = worker_encoder(path)
        forms = [Decoder(encoder.vocab), Decoder(encoder.vocab, "text")]
        for batch in small_batches(batches, text):
            rows = []
            for raw in binary_texts(batch, text):
                n, kept, said = 0, [], hashlib.sha256()
                digests = [hashlib.sha256() for _ in forms]
                for x in forms:
                    x.reset()
                for ids in encoder.stream(raw or b""):
                    said.update(ids)
                    numbers = array("I", ids)
                    n += len(numbers)
                    for digest, x in zip(digests, forms, strict=True):
                        digest.update(x.feed(numbers).encode("utf-8"))
                    if keep_ids:
                        kept.append(ids)
                for digest, x in zip(digests, forms, strict=True):
                    digest.update(x.finish().encode("utf-8"))
                rows.append((n, said.hexdigest(), *[x.hexdigest() for x in digests], b"".join(kept)))
            out = {"doc_id": batch.column(key), "n_tokens": pa.array([r[0] for r in rows], pa.int64())}
            for i, name in enumerate(("ids_sha256", "decoded_sha256", "text_sha256"), 1):
                out[name] = pa.array([r[i] for r in rows], pa.string())
            if keep_ids:
                out["ids"] = pa.array([r[4] for r in rows], pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    return run


def encode_documents(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", keep_ids: bool = False
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, text_sha256) of every row's whole text, and
    with keep_ids the ids as little-endian unsigned 32-bit integers.

    ids_sha256 is over those integers, decoded_sha256 over the tokens joined by spaces, as a
    tokenizer file without a decoder decodes, text_sha256 over the bytes' own text with a space
    for each word end, both in UTF-8; all in lowercase hex. A null text counts as empty: no ids,
    and the digests of nothing. Repeated rows stay repeated, null keys are kept, other columns
    are not read, and an empty table gives an empty result. `path` is a tokenizer file that
    every executor can open.
    """
    kind = dict(docs.dtypes)[key]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, text_sha256 string"
    return docs.select(key, text).mapInArrow(
        _encode(key, text, path, keep_ids), schema + ", ids binary" * keep_ids
    )
