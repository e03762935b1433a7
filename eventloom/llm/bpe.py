"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

A text is read once. Its pre-tokens (runs of letters, single numerals, runs of other
non-spaces, a few English suffixes) go through a transducer that keeps, for each of the last
`width` symbols read, the one token that ends the encoding of the text up to there. `width`
is the length of the longest token, the merge list's sufficient lookahead: whatever follows,
the next token starts at one of those last positions, so a token that all of them share as
an ancestor is stable and is emitted. The state does not grow with the text. A pre-token of up to
`width` symbols lies within the lookahead, so that none of its tokens is sure to be stable before its end; its
tokens are found then, by the same test of neighbours.

That each prefix has one encoding, and that it can be told from neighbouring pairs alone,
follows from the merge list: a sequence is the encoding if and only if each token encodes to
itself and no merge of a lower rank would have crossed the border of a neighbouring pair
(`Merges.fits`, which undoes the merges of both sides from the last one on).

Decoding is a state machine over ids. A vocabulary file without a decoder, as word_bpe_49k,
decodes to the tokens' own strings with one space between them; one with a byte-level decoder
goes through an incremental UTF-8 decoder, which holds back at most an unfinished character.

Texts are read SLICE characters at a time, and ids go to the decoder and to the digests slice by slice.

Defined results: a null text is the empty text (no tokens); the strings of special tokens in
a text are those tokens, as in the tokenizers library; an empty table gives no rows; columns
other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from eventloom.llm.common import prepare, strings

#: Bounds of a worker's memories, in entries: words and chunks already encoded, pairs already judged.
KEPT = 240_000
#: Characters of a text that are read at a time (more where no space follows), and chunks that are decoded together.
SLICE, RUN = 1 << 16, 4096

END = "</w>"
# Unicode's White_Space property, and the file's pre-token pattern.
SPACES = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: A space after which a text may be cut: no letter is composed with it, and no token holds it.
ASCII_SPACE = regex.compile(r"[\t-\r ]")
#: Spaces to str.split, but not to the file.
PY_SPACES = "\x1c\x1d\x1e\x1f"
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte, by the published rule of byte-level BPE."""
    out, spare = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(spare)
            spare += 1
    return [out[b] for b in range(256)]


def symbols_of(token: str) -> list[str]:
    if token.endswith(END) and len(token) > len(END):
        head = token[: -len(END)]
        return [*head[:-1], head[-1] + END]
    return list(token)


class Merges:
    """A merge list: which tokens encode to themselves, and which can be neighbours."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.parts: dict[str, tuple[str, str]] = {}
        for a, b in pairs:
            self.parts.setdefault(a + b, (a, b))
        base = {x for c in byte_alphabet() for x in (c, c + END)}
        self.valid = {t for t in self.ids if t in base or (t in self.parts and self.apply(symbols_of(t)) == [t])}
        #: The sufficient lookahead, in symbols.
        self.width = max(len(symbols_of(t)) for t in self.valid)
        self.judged: dict[tuple[str, str], bool] = {}
        #: By the first three symbols, the most symbols that a token has.
        self.reach: dict[str, int] = {}
        for t in self.valid:
            s = t.removesuffix(END) or t
            self.reach[s[:3]] = max(self.reach.get(s[:3], 0), len(s))

    def apply(self, s: list[str]) -> list[str]:
        """The merge loop as defined, lowest rank first and from the left; used on vocabulary entries and in tests."""
        while len(s) > 1:
            pair = min(zip(s, s[1:]), key=lambda p: self.rank.get(p, 1 << 60))
            if pair not in self.rank:
                break
            out: list[str] = []
            i = 0
            while i < len(s):
                both = i + 1 < len(s) and (s[i], s[i + 1]) == pair
                out.append(s[i] + s[i + 1] if both else s[i])
                i += 1 + both
            s = out
        return s

    def fits(self, a: str, b: str) -> bool:
        """Whether a and b stay apart when they stand side by side."""
        got = self.judged.get((a, b))
        if got is None:
            if len(self.judged) >= KEPT:
                self.judged.clear()
            got = self.judged[a, b] = self._apart(a, b)
        return got

    def _apart(self, a: str, b: str) -> bool:
        rank, parts, limit = self.rank, self.parts, 1 << 60
        while True:
            if rank.get((a, b), 1 << 61) < limit:
                return False  # this merge would have come first
            ra = rank[parts[a]] if a in parts else -1
            rb = rank[parts[b]] if b in parts else -1
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, parts[a][1]
            else:  # merges of one rank run from the left, so over the border before inside b
                limit, b = rb + 1, parts[b][0]


class Transducer:
    def __init__(self, merges: Merges):
        self.m = merges

    def word(self, w: str) -> list[str]:
        """Tokens of a pre-token within the lookahead (a string over the byte alphabet): the longest token that fits
        each time, stepping back where none does. Since every prefix has one encoding, a position
        that has failed once need not be tried again."""
        valid, fits, n = self.m.valid, self.m.fits, len(w)
        reach, judged = self.m.reach.get, self.m.judged.get
        out: list[str] = []
        ends: list[int] = []
        dead: set[int] = set()
        i, last = 0, ""
        j = min(n, reach(w[:3], 2))
        while i < n:
            piece = w[i:j] + END if j == n else w[i:j]
            if piece in valid and j not in dead:
                ok = judged((last, piece)) if last else True
                if ok is None:
                    ok = fits(last, piece)
                if ok:
                    out.append(piece)
                    ends.append(i)
                    last, i = piece, j
                    j = min(n, i + reach(w[i : i + 3], 2))
                    continue
            j -= 1
            while j == i:
                if not out:
                    raise ValueError(f"no token for {w!r}: the vocabulary lacks a symbol")
                dead.add(i)
                out.pop()
                j = i - 1
                i = ends.pop()
                last = out[-1] if out else ""
        return out

    def stream(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of a pre-token of any length, each as soon as it is stable.

        A node is [token, the node before]; nodes holds those of the last `width` positions."""
        valid, fits, width = self.m.valid, self.m.fits, self.m.width
        base: list = ["", None]  # what was emitted last
        nodes, recent, since = [base], [], 0
        for sym in symbols:
            recent.append(sym)
            recent = recent[-width:]
            for j in range(len(nodes) - len(recent), len(nodes)):
                piece = "".join(recent[j - len(nodes) :])
                if piece in valid and (not nodes[j][0] or fits(nodes[j][0], piece)):
                    nodes.append([piece, nodes[j]])
                    break
            nodes = nodes[-width - 1 :]
            since += 1
            if since >= width:
                since = 0
                shared = None
                for node in nodes[-width:]:
                    chain = []
                    while node is not base:
                        chain.append(node)
                        node = node[1]
                    chain.reverse()
                    if shared is None:
                        shared = chain
                    else:
                        k = 0
                        while k < min(len(shared), len(chain)) and shared[k] is chain[k]:
                            k += 1
                        shared = shared[:k]
                if shared:
                    for node in shared:
                        yield node[0]
                    base = shared[-1]
                    base[1] = None
        rest, node = [], nodes[-1]
        while node is not base:
            rest.append(node[0])
            node = node[1]
        yield from reversed(rest)


class Decoder:
    """Ids in, text out, some ids at a time. What it keeps in between is whether a token came before, or the
    bytes of an unfinished character."""

    def __init__(self, spec: dict):
        token = {i: t for t, i in spec["model"]["vocab"].items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.bytes = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        of = {c: b for b, c in enumerate(byte_alphabet())}
        #: What each id, written in decimals, stands for.
        self.token = {str(i): (bytes(of[c] for c in t) if all(c in of for c in t) else t.encode()) if self.bytes else t for i, t in token.items()}
        self.reset()

    def reset(self) -> None:
        self.started = False
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[str]) -> str:
        """The text that these ids add. Ids without a token add none."""
        got = [t for t in map(self.token.get, ids) if t is not None]
        if self.bytes:
            return self.state.decode(b"".join(got))
        out = " ".join(got)
        if got and self.started:
            out = " " + out
        self.started |= bool(got)
        return out

    def finish(self) -> str:
        """What was held back; the decoder is new after it."""
        out = self.state.decode(b"", True) if self.bytes else ""
        self.reset()
        return out


class Codec:
    """Texts to ids and back, with bounded memories of chunks (runs of non-spaces) and words."""

    def __init__(self, blob: str):
        spec = json.loads(blob)
        self.merges, self.decoder = Merges(spec), Decoder(spec)
        self.transducer = Transducer(self.merges)
        self.alphabet = byte_alphabet()
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.number = {t: str(i) for t, i in self.merges.ids.items()}
        self.words: dict[str, list[str]] = {}
        self.chunks: dict[str, tuple[int, str]] = {}
        self.older: dict[str, tuple[int, str]] = {}  # the generation of chunks before

    def piece(self, p: str) -> list[str]:
        """Tokens of a pre-token."""
        w = p if p.isascii() and p.isprintable() else "".join([self.alphabet[b] for b in p.encode()])
        if len(w) > self.merges.width:
            return list(self.transducer.stream([*w[:-1], w[-1] + END]))
        return self.transducer.word(w)

    def chunk(self, c: str) -> tuple[int, str]:
        """Count and ids of a lower-cased run of non-spaces. Pre-tokens have no spaces, so chunks are independent."""
        got = self.older.get(c)
        if got is None and len(c) > 1 and not c[-1].isalpha() and c[:-1].isalpha():
            # A word and one mark are two pre-tokens: the word may be known without the mark.
            a, b = (self.chunks.get(x) or self.chunk(x) for x in (c[:-1], c[-1]))
            if a[0] and b[0]:
                got = a[0] + b[0], f"{a[1]} {b[1]}"
        if got is None:
            if c.isalpha():
                tokens = self.piece(c)
            else:
                tokens = []
                for p in PIECES.findall(c):
                    t = self.words.get(p)
                    if t is None:
                        t = self.piece(p)
                        if len(self.words) >= KEPT:
                            self.words.clear()
                        if len(p) <= self.merges.width:
                            self.words[p] = t
                    tokens += t
            number = self.number
            got = len(tokens), " ".join([number[t] for t in tokens])
        if len(c) <= 2 * self.merges.width:
            if len(self.chunks) >= KEPT // 2:
                self.older, self.chunks = self.chunks, {}
            self.chunks[c] = got
        return got

    def parts(self, text: str) -> Iterator[list[tuple[int, str]]]:
        """Count and ids of the chunks, some chunks at a time."""
        at = 0
        if self.split and any(s in text for s in self.special):
            for m in self.split.finditer(text):
                yield from self.parts_of(text, at, m.start())
                yield [(1, str(self.special[m.group()]))]
                at = m.end()
        yield from self.parts_of(text, at, len(text))

    def parts_of(self, text: str, begin: int, end: int) -> Iterator[list[tuple[int, str]]]:
        while begin < end:
            cut = end
            if end - begin > SLICE:
                space = ASCII_SPACE.search(text, begin + SLICE, end)
                cut = space.end() if space else end
            yield self.slice(text[begin:cut])
            begin = cut

    def slice(self, text: str) -> list[tuple[int, str]]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # Letter by letter, as the file's normaliser; only a final sigma depends on what is around it.
        text = text.lower() if "Σ" not in text else "".join([x.lower() for x in text])
        seen, chunk = self.chunks.get, self.chunk
        plain = not any(x in text for x in PY_SPACES)
        return [g for c in (text.split() if plain else SPACES.split(text)) if c for g in (seen(c) or chunk(c),) if g[0]]

    def encode(self, text: str) -> list[int]:
        return [int(i) for part in self.parts(text) for p in part for i in p[1].split(" ")]

    def decode(self, ids: Iterable[int]) -> str:
        return self.decoder.feed(map(str, ids)) + self.decoder.finish()

    def digest(self, text: str) -> tuple[int, str, str]:
        """Count of tokens, and SHA-256 of the ids and of what the ids decode to."""
        n, ids, texts, between = 0, hashlib.sha256(), hashlib.sha256(), ""
        for part in self.parts(text):
            for k in range(0, len(part), RUN):
                run = part[k : k + RUN]
                n += sum([p[0] for p in run])
                said = " ".join([p[1] for p in run])
                ids.update((between + said).encode())
                texts.update(self.decoder.feed(said.split(" ")).encode("utf-8", "surrogatepass"))
                between = " "
        texts.update(self.decoder.finish().encode())
        return n, ids.hexdigest(), texts.hexdigest()


_codecs: dict[int, Codec] = {}


def codec(blob: str) -> Codec:
    """One per worker and file: workers are reused between tasks."""
    key = hash(blob)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(blob)
    return _codecs[key]


def _digest(batches: Iterator[pa.RecordBatch], blob) -> Iterator[pa.RecordBatch]:
    c = codec(blob.value)
    for b in batches:
        n, ids, texts = zip(*map(c.digest, strings(b.column(1))), strict=True) if b.num_rows else ((),) * 3
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _encode(batches: Iterator[pa.RecordBatch], blob) -> Iterator[pa.RecordBatch]:
    c = codec(blob.value)
    for b in batches:
        ids = [c.encode(t) for t in strings(b.column(1))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], blob) -> Iterator[pa.RecordBatch]:
    c = codec(blob.value)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])


def _file(df: DataFrame, path: str):
    """The vocabulary file, read on the driver: its size does not depend on the data."""
    prepare(df.sparkSession)
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _in(docs: DataFrame, value: str = "text") -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[value])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int)."""
    return _in(docs).mapInArrow(partial(_encode, blob=_file(docs, path)), "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids."""
    return _in(ids, "ids").mapInArrow(partial(_decode, blob=_file(ids, path)), "doc_id long, text string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each text."""
    return _in(docs).mapInArrow(partial(_digest, blob=_file(docs, path)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
