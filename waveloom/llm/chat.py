"""Chat formatting as prefix trees: conversations that share initial turns share their tokens, emitted once depth-first."""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import settle, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"  # a byte-level vocabulary: every text has tokens and comes back unchanged
PACK_CHARS = 200_000   # characters of a pack, about (a longer conversation has a pack of its own)
DIGEST = 12            # bytes of a prefix key
SLICE_BYTES = 512 << 20  # bytes of text that are shuffled at a time, about
MOST_SLICES = 4
WORDS = 1 << 18        # words whose tokens a task remembers, at most

# The template: <|role|>, new line, text, <|end|>, new line. Texts and roles cannot hold its signs, these are escaped.
_ESCAPES = {"\\": "\\\\", "<": "\\l", ">": "\\g", "[": "\\b", "]": "\\d"}
_BACK = {v: k for k, v in _ESCAPES.items()}
_TURN = re.compile(r"<\|([^<>]*)\|>\n([^<>]*)<\|end\|>\n")
END = "<|end|>\n"
LEARNED = "assistant"  # the role whose texts are under the loss mask

PACK = ("tokens array<int>, positions array<int>, loss array<boolean>, nodes array<struct<start int, stop int, parent int, position int>>, "
        "attends array<array<struct<start int, stop int>>>, leaves array<struct<conv_id {}, node int>>")


def escape(text: str) -> str:
    return re.sub(r"[\\<>\[\]]", lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[0]], text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


# The words of the byte-level split (GPT-2) of a text of these signs, whose classes are the same in any version of Unicode.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_COMMON = re.compile(f"[\t\n\r -~{_LETTER}]*")
_SIGNS = re.compile(r"[<>\[\]]")
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\\s{_LETTER}0-9]+|\\s+(?!\\S)|\\s+")


def _byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}


class _Words(dict):
    """Tokens (int32 bytes) of words. About WORDS of them are remembered; later ones, which are mostly rare, for one call."""

    def __init__(self, encode):
        self.encode, self.rare = encode, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.rare.get(word)
        if ids is None:
            ids = np.array(self.encode(word, add_special_tokens=False).ids, np.int32).tobytes()
            if len(word) <= 40 and len(self) < WORDS:
                self[word] = ids
        return ids

    def learn(self, wanted: set[str]) -> None:
        """Tokens of the new words that begin with a space: a text of them all is split into just these, for half the time of single calls."""
        new, self.rare = [w for w in wanted if w not in self and w[0] == " " and w[1:].isalpha() and len(w) <= 40], {}
        if not new:
            return
        e = self.encode("".join(new), add_special_tokens=False)
        ids, word = np.array(e.ids, np.int32).tobytes(), np.array(e.word_ids)
        cuts = (np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1], [True]])) * 4).tolist()
        if len(cuts) == len(new) + 1:
            (self if len(self) + len(new) <= WORDS else self.rare).update((w, ids[i:j]) for w, i, j in zip(new, cuts[:-1], cuts[1:]))


class _Tokenizer:
    """Tokens of texts and texts of tokens, as the tokenizer of the vocabulary has them.

    Where it splits texts into words by the byte-level rule alone, the tokens of a word are looked up: words come again and again, and
    most of the tokenizer's time goes into what nobody asks of it (offsets, words, masks).
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.inner = Tokenizer.from_str(vocabulary)
        self.inner.encode_special_tokens = True
        self.words = _Words(self.inner.encode)
        spec = json.loads(vocabulary)
        level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        model = {k: v for k, v in spec["model"].items() if k != "merges"}
        added = [t["content"] for t in spec.get("added_tokens") or []]
        self.plain = (
            {k: v for k, v in (spec.get("pre_tokenizer") or {}).items() if k != "trim_offsets"} == level and (spec.get("decoder") or {}).get("type") == "ByteLevel"
            and not any(spec.get(k) for k in ("normalizer", "post_processor", "truncation", "padding")) and model.get("type") == "BPE" and not model.get("dropout")
            and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "unk_token")) and all(map(_SIGNS.search, added)))
        self.bytes: list[bytes] = []
        if self.plain:
            signs = _byte_signs()
            self.bytes = [b""] * (max([*model["vocab"].values(), *(t["id"] for t in spec.get("added_tokens") or [])], default=-1) + 1)
            for word, k in model["vocab"].items():
                self.bytes[k] = bytes(signs[c] for c in word) if all(c in signs for c in word) else word.encode()
            for t in spec.get("added_tokens") or []:
                self.bytes[t["id"]] = t["content"].encode()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """int32 tokens of each text. Texts come escaped: an added token, which has one of the escaped signs, cannot be in one of common signs."""
        words = [_WORD.findall(t) if self.plain and _COMMON.fullmatch(t) and not _SIGNS.search(t) else None for t in texts]
        self.words.learn({w for ws in words for w in ws or ()})
        out = [None if ws is None else np.frombuffer(b"".join(map(self.words.__getitem__, ws)), np.int32) for ws in words]
        left = [k for k, ids in enumerate(out) if ids is None]
        for k, e in zip(left, self.inner.encode_batch([texts[k] for k in left], add_special_tokens=False) if left else []):
            out[k] = np.array(e.ids, np.int32)
        return out

    def decode(self, runs: list[np.ndarray]) -> list[str]:
        if not self.plain:
            return self.inner.decode_batch([r.tolist() for r in runs], skip_special_tokens=False)
        return [b"".join(map(self.bytes.__getitem__, r.tolist())).decode("utf-8", "replace") for r in runs]


@functools.lru_cache(maxsize=2)
def _tokenizer(vocabulary: str) -> _Tokenizer:
    return _Tokenizer(vocabulary)


def by_conversation(rows: DataFrame, slices: int = 1) -> DataFrame:
    """conv_id, path, roles, texts: the turns of each conversation in order, and the keys of its prefixes.

    path chains one digest per turn over role and text, so two conversations share exactly the turns of their common path.
    Rows of a conversation are streamed in order; only one conversation is held at a time. Slices of the conversations are shuffled
    and stored one after the other, which bounds the shuffle files.
    """
    id_type = rows.schema["conv_id"].dataType.simpleString()
    arrow_id = rows.select("conv_id").limit(0).toArrow().schema.field(0).type
    names = ["conv_id", "path", "roles", "texts"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, roles, texts, ready, held = None, [], [], [], 0

        def path() -> bytes:
            key, out = b"", []
            for role, text in zip(roles, texts):
                key = hashlib.blake2b(key + len(role.encode()).to_bytes(8, "little") + role.encode() + text.encode(), digest_size=DIGEST).digest()
                out.append(key)
            return b"".join(out)

        def batch() -> pa.RecordBatch:
            cols = list(zip(*ready))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (arrow_id, pa.binary(), pa.list_(pa.string()), pa.list_(pa.string())))], names)

        for b in batches:
            for conv, role, text in zip(*[b.column(k).to_pylist() for k in (0, 2, 3)]):
                if roles and conv != now:
                    ready.append((now, path(), roles, texts))
                    held += sum(map(len, texts))
                    roles, texts = [], []
                    if held > PACK_CHARS * 8 or len(ready) >= 2000:
                        yield batch()
                        ready, held = [], 0
                now = conv
                roles.append(role or "")
                texts.append(text or "")
        if roles:
            ready.append((now, path(), roles, texts))
        if ready:
            yield batch()

    def stored(t: DataFrame) -> DataFrame:
        t = t.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
        return settle(t.mapInArrow(gather, f"conv_id {id_type}, path binary, roles array<string>, texts array<string>"), "conversations")

    t = rows.select("conv_id", "turn", "role", "text")
    return functools.reduce(DataFrame.unionAll, [stored(x) for x in _sliced(t, F.col("conv_id"), slices)])


def _sliced(df: DataFrame, key: Column, slices: int) -> list[DataFrame]:
    return [df.where(F.pmod(F.xxhash64(key), F.lit(slices)) == k) for k in range(slices)] if slices > 1 else [df]


class _Pack:
    """Nodes in depth-first order while conversations come in the order of their paths."""

    def __init__(self):
        self.nodes, self.pieces, self.stack, self.leaves, self.chars = [], [], [], [], 0

    def add(self, conv, path: bytes, roles: list[str], texts: list[str]) -> None:
        keys = [path[i:i + DIGEST] for i in range(0, len(path), DIGEST)]
        shared = 0
        while shared < min(len(self.stack), len(keys)) and self.stack[shared][0] == keys[shared]:
            shared += 1
        del self.stack[shared:]
        for k in range(shared, len(keys)):
            self.nodes.append(self.stack[-1][1] if self.stack else -1)
            self.stack.append((keys[k], len(self.nodes) - 1))
            piece = (f"<|{escape(roles[k])}|>\n", escape(texts[k]), roles[k] == LEARNED)
            self.pieces.append(piece)
            self.chars += len(piece[0]) + len(piece[1]) + len(END)
        self.leaves.append({"conv_id": conv, "node": self.stack[-1][1]})

    def row(self, tokenizer: _Tokenizer) -> tuple:
        heads, texts, learned = zip(*self.pieces)
        ends, = tokenizer.encode([END])
        coded, nodes, attends = tokenizer.encode([*heads, *texts]), [], []
        size = np.array([(len(coded[k]), len(coded[len(heads) + k]), len(ends)) for k in range(len(heads))])
        own = size.sum(1)
        stop = np.cumsum(own)
        for k, parent in enumerate(self.nodes):
            position = nodes[parent]["position"] + nodes[parent]["stop"] - nodes[parent]["start"] if parent >= 0 else 0
            nodes.append({"start": int(stop[k] - own[k]), "stop": int(stop[k]), "parent": parent, "position": position})
            above = list(attends[parent]) if parent >= 0 else []
            if parent >= 0:
                last = {"start": nodes[parent]["start"], "stop": nodes[parent]["stop"]}
                if above and above[-1]["stop"] == last["start"]:
                    last["start"] = above.pop()["start"]
                above.append(last)
            attends.append(above)
        tokens = np.concatenate([x for k in range(len(heads)) for x in (coded[k], coded[len(heads) + k], ends)])
        positions = np.arange(len(tokens), dtype=np.int32) + np.repeat([n["position"] - n["start"] for n in nodes], own).astype(np.int32)
        under = np.zeros(size.shape, bool)
        under[:, 1] = learned
        return tokens, positions, np.repeat(under.ravel(), size.ravel()), nodes, attends, self.leaves


def _builder(vocabulary: str, arrow_id: pa.DataType, pack_chars: int):
    """Packs (one row a batch) of batches of conversations in the order of their paths."""
    span = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
    node = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("parent", pa.int32()), ("position", pa.int32())])
    types = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(node), pa.list_(pa.list_(span)),
             pa.list_(pa.struct([("conv_id", arrow_id), ("node", pa.int32())]))]
    names = ["tokens", "positions", "loss", "nodes", "attends", "leaves"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, pack = _tokenizer(vocabulary), _Pack()

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(pack.row(tokenizer), types)], names)

        for b in batches:
            for r in range(b.num_rows):
                pack.add(*[c[r].as_py() for c in b.columns])
                if pack.chars >= pack_chars or len(pack.leaves) >= 5000:
                    yield done()
                    pack = _Pack()
        if pack.leaves:
            yield done()

    return build


def _reader(vocabulary: str, arrow_id: pa.DataType):
    """What read_back says of batches of packs."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(vocabulary)
        for b in batches:
            for tokens, loss, nodes, leaves in zip(*[b.column(c) for c in ("tokens", "loss", "nodes", "leaves")]):
                tokens, loss, nodes = tokens.values.to_numpy(), loss.values.to_numpy(zero_copy_only=False), nodes.as_py()
                spans = [slice(n["start"], n["stop"]) for n in nodes]
                texts = tokenizer.decode([tokens[s] for s in spans])
                under = tokenizer.decode([tokens[s][loss[s]] for s in spans])
                known, out = {}, []
                for leaf in leaves.as_py():
                    k = leaf["node"]
                    if k not in known:
                        line, at = [], k
                        while at >= 0:
                            line.append(at)
                            at = nodes[at]["parent"]
                        formatted = "".join(texts[x] for x in reversed(line))
                        turns = parse(formatted)
                        learned = "".join(unescape(under[x]) for x in reversed(line))
                        known[k] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learned),
                                    hashlib.sha256(learned.encode()).hexdigest(), len(formatted))
                    out.append((leaf["conv_id"], *known[k]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (arrow_id, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))],
                                                 ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return read


READ = "conv_id {}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _in_order(conversations: DataFrame) -> tuple[DataFrame, str, pa.DataType]:
    """Conversations in the order of their paths, and the two types of conv_id."""
    id_type = conversations.schema["conv_id"].dataType.simpleString()
    arrow_id = conversations.select("conv_id").limit(0).toArrow().schema.field(0).type
    return conversations.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id"), id_type, arrow_id


def packs(conversations: DataFrame, vocabulary: str, pack_chars: int = PACK_CHARS) -> DataFrame:
    """Packs of prefix trees. Each node holds the tokens of one turn once.

    Per token: position (tokens before it in its own conversation) and loss. Per node: its interval, parent and the intervals of
    its ancestors, which it may attend to besides its own earlier tokens. leaves: the node where each conversation ends.
    A pack is cut by size, so a first turn that a third of all conversations share is repeated once a pack, never gathered.
    """
    ordered, id_type, arrow_id = _in_order(conversations)
    return settle(ordered.mapInArrow(_builder(vocabulary, arrow_id, pack_chars), PACK.format(id_type)), "packs")


def read_back(packed: DataFrame, vocabulary: str) -> DataFrame:
    """From the packs alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation."""
    id_type = packed.schema["leaves"].dataType.elementType["conv_id"].dataType.simpleString()
    arrow_id = packed.select(F.col("leaves")[0]["conv_id"]).limit(0).toArrow().schema.field(0).type
    return packed.select("tokens", "loss", "nodes", "leaves").mapInArrow(_reader(vocabulary, arrow_id), READ.format(id_type))


def packs_read_back(conversations: DataFrame, vocabulary: str, slices: int = 1, pack_chars: int = PACK_CHARS) -> DataFrame:
    """What read_back says of the packs of conversations, each pack read where it was made: packs need more disk than their texts.

    Conversations with the same first turn are in the same slice.
    """
    def read(t: DataFrame) -> DataFrame:
        ordered, id_type, arrow_id = _in_order(t)
        build, back = _builder(vocabulary, arrow_id, pack_chars), _reader(vocabulary, arrow_id)
        return ordered.mapInArrow(lambda batches: back(build(batches)), READ.format(id_type))

    if slices == 1:
        return read(conversations)
    parts = _sliced(conversations, F.substring("path", 1, DIGEST), slices)
    return functools.reduce(DataFrame.unionAll, [settle(read(t), "read-back") for t in parts])


def vocabulary_text(path: str = VOCABULARY) -> str:
    """The vocabulary file, read on the driver and shipped with the tasks (a few MB)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def format_conversations(rows: DataFrame, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """Packs of conversations(conv_id, turn, role, text).

    Turns are ordered by turn (nulls first, ties by role and text); repeated rows are turns of their own. Null roles and texts
    are empty. Rows with a null conv_id form one conversation. An empty table gives no packs.
    """
    return packs(by_conversation(rows), vocabulary_text(vocabulary_path))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    rows = rows.unionByName(extra)
    text_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, min(MOST_SLICES, -(-text_bytes // SLICE_BYTES)))
    return packs_read_back(by_conversation(rows, slices), vocabulary_text(), slices)


def _escaped_chars(x: str) -> str:
    return f"(length({x}) + length({x}) - length(translate({x}, '\\<>[]', '')))"


OP3_SQL = f"""WITH A AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    G AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS t,
      coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS l,
      sum({_escaped_chars('role')} + {_escaped_chars('text')} + 13) AS f FROM A GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(t) AS turns_sha256, length(l)::BIGINT AS loss_chars, sha256(l) AS loss_sha256, f::BIGINT AS formatted_chars FROM G"""
