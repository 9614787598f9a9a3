"""BPE encoding and decoding by a tokenization automaton.

The automaton accepts the token sequences that the merges can produce. It starts as one state that loops on every
base symbol. The gadget of a merge (a, b) -> c splits the state that a leads to: the copy that a now leads to has no
arc for b, and every state with an arc for a gets an arc for c, which leads where b led from there. So the state after
a token depends on that token alone: it is the state after the token's right part as it stood when the merge came,
less what later gadgets took away; and an arc for c is absent exactly where an arc for its left part was absent
at that time. `taken` keeps what each gadget took and when; a transition is looked up along these two spines, and
kept in a table. A word has one accepted path, so each of its prefixes ends in one token; encoding goes over the
positions once and follows the table. Decoding emits the label of each arc.

Null and empty texts have no tokens. Texts of any length go through word by word.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from panelspark.llm.common import arrow_map, documents

END = "</w>"
# Capitals that the library's case mapping knows and version 15.1 of the character database does not, with their small letters.
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
# Letters and digits that version 16.0 of Unicode added to 15.1 (first and last of each run).
ADDED = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B),
    (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C), (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
]
WORDS_KEPT, ARCS_KEPT = 200_000, 1_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in out:
            out[b], extra = chr(extra), extra + 1
    return [out[b] for b in range(256)]


class Automaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        self.vocab = vocab
        n = max(vocab.values(), default=-1) + 1
        self.label = [""] * n
        for text, i in vocab.items():
            self.label[i] = text
        self.left, self.right, self.born = [-1] * n, [-1] * n, [-1] * n
        self.taken: dict[int, int] = {}  # (a, b) as a << 32 | b: when the gadget took the arc b from the state after a
        self.arcs: dict[int, bool] = {}
        for when, (a, b) in enumerate(merges):
            self.gadget(vocab[a], vocab[b], vocab[a + b], when)
        self.longest = max((len(t.removesuffix(END)) for t in vocab), default=0)
        self.trie: dict = {}  # of the labels that do not end a word: "" leads to the label's number
        for text, i in vocab.items():
            if not text.endswith(END):
                node = self.trie
                for x in text:
                    node = node.setdefault(x, {})
                node[""] = i

    def gadget(self, a: int, b: int, c: int, when: int) -> None:
        self.taken.setdefault(a << 32 | b, when)
        self.left[c], self.right[c], self.born[c] = a, b, when

    def arc(self, after: int, token: int) -> bool:
        """Is there an arc for token from the state that `after` leads to?"""
        key = after << 32 | token
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) >= ARCS_KEPT:
                self.arcs.clear()
            known = self.arcs[key] = self._arc(after, token)
        return known

    def _arc(self, after: int, token: int) -> bool:
        taken, left, right, born = self.taken, self.left, self.right, self.born
        never = len(taken) + len(born) + 1
        p, until_p = after, never
        while p >= 0:
            x, until_x = token, never
            while x >= 0:
                when = taken.get(p << 32 | x)
                if when is not None and when < until_p and when <= until_x:  # equal: the gadget of a merge of a with itself
                    return False
                until_x, x = born[x], left[x]
            until_p, p = born[p], right[p]
        return True

    def path(self, word: str, end: str = END) -> list[int]:
        """The labels of the path that spells word (in byte symbols), its last symbol closed by `end`.

        From each place the trie of labels gives the arcs that the word may take next; it ends where no label goes on.
        """
        n, vocab, arcs, arc, root = len(word), self.vocab, self.arcs, self.arc, self.trie
        last, back = [-1] * (n + 1), [0] * (n + 1)
        for j in range(n):
            before = last[j]
            if j and before < 0:
                continue
            node, i, key = root, j, before << 32
            while i < n:
                node = node.get(word[i])
                if node is None:
                    break
                i += 1
                if i == n:
                    break
                token = node.get("")
                if token is not None and last[i] < 0:
                    ok = True if not j else arcs.get(key | token)
                    if ok or ok is None and arc(before, token):
                        last[i], back[i] = token, j
            if last[n] < 0 and n - j <= self.longest:
                token = vocab.get(word[j:] + end)
                if token is not None and (not j or arc(before, token)):
                    last[n], back[n] = token, j
        if n and last[n] < 0:
            raise ValueError(f"no path for {word!r}")
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        return out[::-1]


class Tokenizer:
    """Splits, encodes and decodes as the tokenizer of a JSON file does: NFC, lower case, words that carry an end mark."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.machine = Automaton(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        # Characters younger than version 16.0 are no letters or digits to the library; the pattern engine here knows them.
        added = {c for a, z in ADDED for c in range(a, z + 1)}
        young = "".join(regex.findall(r"[\p{L}\p{N}]", "".join(chr(c) for c in range(0x80, 0x110000) if c not in added and unicodedata.category(chr(c)) == "Cn")))
        self.capital = frozenset(map(chr, LOWER))
        self.young = frozenset(young)
        self.young_words = regex.compile("(?V1)" + pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{young}])").replace(r"[\p{L}]", rf"[\p{{L}}--[{young}]]").replace(r"[\p{N}]", rf"[\p{{N}}--[{young}]]")) if young else self.words
        symbols = byte_symbols()
        self.spell = {i: s for i, s in enumerate(symbols)}
        self.labels = [*self.machine.label]
        for text, i in self.special.items():
            self.labels += [""] * (i + 1 - len(self.labels))
            self.labels[i] = text
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode_word(self, word: str) -> bytes:
        ids = self.older.get(word) or np.array(self.machine.path(word.encode().decode("latin-1").translate(self.spell)), "<u4").tobytes()
        if len(self.known) >= WORDS_KEPT:  # words met again since the last turn stay
            self.older, self.known = self.known, {}
        self.known[word] = ids
        return ids

    def split(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each character's lower case, whatever follows it
            if not self.young.isdisjoint(text):
                return self.young_words.findall(text.translate(LOWER).lower())
            if not self.capital.isdisjoint(text):
                text = text.translate(LOWER)
        return self.words.findall(text.lower())

    def _encode(self, text: str) -> bytes:
        known, encode_word = self.known, self.encode_word
        return b"".join([known.get(w) or encode_word(w) for w in self.split(text)])

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.cut is None or "<|" not in text:
            return self._encode(text)
        return b"".join(np.uint32(self.special[p]).tobytes() if p in self.special else self._encode(p) for p in self.cut.split(text))

    def decode(self, ids: bytes) -> str:
        """The labels of the ids with a space between each two."""
        labels = self.labels
        return " ".join([labels[i] for i in np.frombuffer(ids, "<u4").tolist()])


_made: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """One per process: a worker compiles the automaton once."""
    if path not in _made:
        _made[path] = Tokenizer(path)
    return _made[path]


def encode_documents(df: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids) of every whole text. `path` must exist on every machine."""

    def make():
        tok = tokenizer(path)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, ids_sha, out_sha, kept = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = tok.encode(text)
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                out_sha.append(hashlib.sha256(tok.decode(ids).encode()).hexdigest())
                if with_ids:
                    kept.append(np.frombuffer(ids, "<u4").astype(np.int32))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns, names = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            return pa.RecordBatch.from_arrays(columns, names=names)

        return each

    return arrow_map(documents(df), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
