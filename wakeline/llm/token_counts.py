"""Greedy word-piece token counts by a linear longest-match automaton.

The vocabulary becomes a trie with failure links. A node's link leads to the
node that stands for what is left once the greedy longest pieces of its string
have been taken off, and the node holds how many pieces that are. So a word is
counted in one walk over its bytes, without going back and without building
pieces.

Pieces that begin a word carry the vocabulary's word mark (a space in a
byte-level vocabulary, U+2581 in others); a word is matched with the mark
before it, and pieces without the mark continue it. A word that no pieces
cover counts as one unknown token. Words are runs of other than ASCII white
space; each one counts by itself, so counts of distinct words are kept in a
bounded memo.

Defined results: null or blank texts have no tokens; repeated rows are answered
row by row; other columns are ignored.
"""

from __future__ import annotations

import base64
import json
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sent, batch, by_text, raws, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
SETTING = "spark.wakeline.vocabulary"
MOST_PIECES, MEMO = 1 << 20, 200_000
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_unknown", pa.int64())])


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of a byte-level vocabulary: printable Latin-1 bytes stand for themselves, the others for U+0100 and up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def read_vocabulary(path: str) -> tuple[bytes, list[bytes]]:
    """(word mark, pieces) of a tokenizers JSON file or a tiktoken rank file. The driver alone reads it."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".tiktoken"):
            return b" ", [base64.b64decode(line.split()[0]) for line in f if line.strip()]
        names = list(json.load(f)["model"]["vocab"])
    if any(x.startswith("Ġ") for x in names):
        alphabet = byte_alphabet()
        return b" ", [bytes(alphabet[c] for c in x) for x in names if all(c in alphabet for c in x)]
    return "▁".encode(), [x.encode() for x in names]


class Automaton:
    """``go``: (node << 8 | byte) -> node; ``link`` and ``popped`` by node (-1: no way on). Node 0 begins a word, node 1 continues it."""

    def __init__(self, mark: bytes, pieces: list[bytes]):
        if len(pieces) > MOST_PIECES:
            raise ValueError(f"more than {MOST_PIECES} pieces")
        self.mark, go, ends, below = mark, {}, set(), [(0, 0), (1, 0)]
        for piece in pieces:
            node = 0 if piece.startswith(mark) else 1
            for byte in piece:
                key = node << 8 | byte
                if key not in go:
                    go[key] = len(below)
                    below.append((node, byte))
                node = go[key]
            if piece:
                ends.add(node)
        link, popped = [-1] * len(below), [0] * len(below)
        children: dict[int, list[int]] = {}
        for node, (parent, _) in enumerate(below[2:], 2):
            children.setdefault(parent, []).append(node)
        queue = deque([*children.get(0, ()), *children.get(1, ())])
        while queue:
            v = queue.popleft()
            queue.extend(children.get(v, ()))
            if v in ends:
                link[v], popped[v] = 1, 1
                continue
            parent, byte = below[v]
            z, count = link[parent], popped[parent]
            while z != -1 and (z << 8 | byte) not in go:
                count += popped[z]
                z = link[z]
            if z != -1:
                link[v], popped[v] = go[z << 8 | byte], count
        self.go, self.link, self.popped = go, link, popped

    def count(self, word: bytes) -> int:
        """Pieces of a word (with its mark); 0 if no pieces cover it."""
        go, link, popped = self.go, self.link, self.popped
        node = total = 0
        for byte in word:
            while (to := go.get(node << 8 | byte)) is None:
                if link[node] == -1:
                    return 0
                total += popped[node]
                node = link[node]
            node = to
        while node != 1:
            if link[node] == -1:
                return 0
            total += popped[node]
            node = link[node]
        return total


class Memo(dict):
    """Tokens by word; negative for an unknown one."""

    def __init__(self, automaton: Automaton, most: int = MEMO):
        self.automaton, self.most = automaton, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = n = self.automaton.count(self.automaton.mark + word) or -1
        return n


def _counted(sent):
    def run(batches):
        memo = Memo(sent.value)
        for b in batches:
            rows = []
            for raw in raws(b.column(1)):
                counts = [memo[w] for w in (raw or b"").split()]
                bad = counts.count(-1)
                rows.append((len(counts), sum(counts) + 2 * bad, bad))
            if rows:
                yield batch(SCHEMA, [b.column(0).to_pylist(), *zip(*rows, strict=True)])

    return run


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of every row."""
    sent = Sent(docs.sparkSession, Automaton(*read_vocabulary(vocabulary)))
    given = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return by_text(given, _counted(sent), "doc_id bigint, n_words bigint, n_tokens bigint, n_unknown bigint")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary is the file that the session names in ``SETTING``, or ``VOCABULARY``; only the driver reads it."""
    return token_counts(table(spark, sf_dir, "documents"), spark.conf.get(SETTING, VOCABULARY))


QUERIES = {"op3_token_counts": op3_token_counts}
SQL: dict[str, str] = {}
