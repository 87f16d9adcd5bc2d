"""Chat formatting as prefix trees: conversations that begin alike share the tokens of their common turns.

Distinct conversations are sorted by their turns, so that one beginning stands next to another and the sorted list is the
tree in depth-first order. A task walks its range of the list and emits the turns that the conversation before does not
have. Every turn carries its position ids and the token spans of its ancestors, which are all that it may attend to
besides itself.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..session import materialise
from .common import bounded_batches
from .tokens import Encoder

#: Control strings of the template (fixed values).
START, END = "<|im_start|>", "<|im_end|>"
#: Tokens after which a block of trees ends with the conversation at hand.
BLOCK_TOKENS = 1 << 18

NODES_DDL = (
    "block string, node long, parent long, turn long, start long, length long, position long, "
    "ancestors array<struct<start: long, end: long>>, ids binary, loss_start long, loss_end long, leaf string"
)
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_NODES = pa.schema(
    [("block", pa.string())]
    + [(n, pa.int64()) for n in ("node", "parent", "turn", "start", "length", "position")]
    + [("ancestors", _SPANS), ("ids", pa.binary()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("leaf", pa.string())]
)
READ_DDL = "leaf string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text):
    """Puts one backslash into every ``<|``, behind those that stand there already, so that no control string is left."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text):
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role):
    """A role ends at the line's end, so its own line breaks are written as ``\\n``."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role):
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Template:
    """Tokens of turns: <|im_start|>role, line break, text, <|im_end|>, line break.

    The two control strings are ids of their own behind the vocabulary.
    """

    def __init__(self, tokenizer):
        from tokenizers import Tokenizer

        self.encoder = Encoder(tokenizer)
        vocabulary = Tokenizer.from_file(tokenizer).get_vocab()
        self.start = max(vocabulary.values()) + 1
        self.end = self.start + 1
        self.bytes = [b""] * (self.end + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = _token_bytes(token)
        self.bytes[self.start], self.bytes[self.end] = START.encode(), END.encode()

    def turn(self, role, text):
        """Ids of a turn, and where its text begins and ends among them."""
        head = np.frombuffer(self.encoder.ids(escape_role(role) + "\n"), "<u4")
        body = np.frombuffer(self.encoder.ids(escape(text)), "<u4")
        tail = np.frombuffer(self.encoder.ids("\n"), "<u4")
        ids = np.concatenate([[self.start], head, body, [self.end], tail]).astype("<u4")
        return ids, 1 + len(head), 1 + len(head) + len(body)

    def text(self, ids):
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode()


def _byte_signs():
    """Byte-level vocabularies write printable bytes as themselves and the others as the next signs from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


_SIGNS = _byte_signs()


def _token_bytes(token):
    try:
        return bytes(map(_SIGNS.__getitem__, token))
    except KeyError:  # an added token is written as it is
        return token.encode()


def whole_conversations(turns):
    """One row per conv_id: its turns in order, their digests in one string (path) and the digest of that (leaf).

    Rows are ordered by turn, nulls first, then by role and text; a null role or text is empty.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    row = F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    grouped = turns.select(F.col("conv_id").cast("long"), row.alias("t")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("t")).alias("turns")
    )
    # 128 bits of a digest of each turn; the role's own digest keeps role and text apart
    mark = F.transform("turns", lambda t: F.substring(F.sha2(F.concat(F.sha2(t.role, 256), t.text), 256), 1, 32))
    path = F.array_join(mark, "")
    return grouped.withColumn("path", path).withColumn("leaf", F.sha2("path", 256))


def prefix_trees(whole, tokenizer, block_tokens=BLOCK_TOKENS):
    """Nodes of the prefix trees over the rows of ``whole_conversations``; one node is one turn.

    A block is a sequence of tokens of its own: nodes of a block, by ``node``, are its trees in depth-first order, and
    ``start`` counts the tokens before a node. ``position`` is the position id of its first token: the number of its
    ancestors' tokens; the others follow one by one. ``ancestors`` are the spans of the block's tokens before the node
    that it attends to, neighbours merged. loss_start and loss_end are places in the block (equal without loss): the
    text of an assistant's turn. ``leaf`` names the conversation that ends with the node.

    Equal conversations are one path. A block ends with the first conversation that makes it ``block_tokens`` long, or with
    its range of the sorted list; a tree that goes on has its common turns once more in the next block.
    """
    spark = whole.sparkSession
    bounded_batches(spark)
    chosen = whole.groupBy("leaf").agg(F.min("conv_id").alias("conv_id"))
    distinct = whole.alias("w").join(
        chosen.alias("c"),
        (F.col("w.leaf") == F.col("c.leaf")) & F.col("w.conv_id").eqNullSafe(F.col("c.conv_id")),
        "left_semi",
    )

    def walk(batches):
        template = Template(tokenizer)
        block, above, cursor, count = None, [], 0, 0
        for batch in batches:
            rows, held = {name: [] for name in _NODES.names}, 0
            for leaf, path, turns in zip(*(batch.column(c).to_pylist() for c in ("leaf", "path", "turns"))):
                marks = [path[i : i + 32] for i in range(0, len(path), 32)]
                if block is None or cursor >= block_tokens:
                    block, above, cursor, count = leaf, [], 0, 0
                same = 0
                while same < min(len(above), len(marks)) and above[same][0] == marks[same]:
                    same += 1
                del above[same:]
                for place in range(same, len(marks)):
                    ids, first, last = template.turn(turns[place]["role"], turns[place]["text"])
                    _, parent, spans, position = above[-1] if above else (None, None, [], 0)
                    if turns[place]["role"] != "assistant":
                        first = last
                    value = {
                        "block": block, "node": count, "parent": parent, "turn": place, "start": cursor,
                        "length": len(ids), "position": position,
                        "ancestors": [{"start": s, "end": e} for s, e in spans], "ids": ids.tobytes(),
                        "loss_start": cursor + first, "loss_end": cursor + last,
                        "leaf": leaf if place == len(marks) - 1 else None,
                    }
                    for name in _NODES.names:
                        rows[name].append(value[name])
                    end = cursor + len(ids)
                    if spans and spans[-1][1] == cursor:
                        spans = [*spans[:-1], (spans[-1][0], end)]
                    else:
                        spans = [*spans, (cursor, end)]
                    above.append((marks[place], count, spans, position + len(ids)))
                    held += len(ids)
                    cursor, count = end, count + 1
                if held > 1 << 20:
                    yield pa.RecordBatch.from_pydict(rows, _NODES)
                    rows, held = {name: [] for name in _NODES.names}, 0
            yield pa.RecordBatch.from_pydict(rows, _NODES)

    ordered = distinct.select("leaf", "path", "turns").repartitionByRange("path").sortWithinPartitions("path")
    return ordered.mapInArrow(walk, NODES_DDL)


def parse(formatted):
    """Turns (role, text) of a formatted conversation."""
    found = []
    for turn in formatted.split(START)[1:]:
        role, text = turn.split("\n", 1)
        found.append((unescape_role(role), unescape(text[: -len(END) - 1])))
    return found


def read_back(nodes, tokenizer):
    """Per conversation of the trees (leaf), what its tokens say: digest columns of its turns and of the loss text.

    A conversation's tokens are those of its last node and of that node's ancestor spans. A task holds one block.
    """

    def read(batches):
        template, block = Template(tokenizer), None
        ids, loss = np.empty(0, np.uint32), np.empty(0, bool)
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["block"] != block:
                    block = row["block"]
                    ids, loss = np.empty(1 << 16, np.uint32), np.zeros(1 << 16, bool)
                start, end = row["start"], row["start"] + row["length"]
                if end > len(ids):
                    more = max(end, 2 * len(ids)) - len(ids)
                    ids = np.concatenate([ids, np.empty(more, np.uint32)])
                    loss = np.concatenate([loss, np.zeros(more, bool)])
                ids[start:end] = np.frombuffer(row["ids"], "<u4")
                loss[row["loss_start"] : row["loss_end"]] = True
                if row["leaf"] is None:
                    continue
                spans = [*((a["start"], a["end"]) for a in row["ancestors"]), (start, end)]
                seen = np.concatenate([ids[s:e] for s, e in spans])
                if len(seen) != row["position"] + row["length"]:
                    raise ValueError("position ids and ancestor spans differ")
                mask = np.concatenate([loss[s:e] for s, e in spans])
                edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
                learned = "".join(unescape(template.text(seen[s:e])) for s, e in zip(edges[::2], edges[1::2]))
                formatted = template.text(seen)
                turns = parse(formatted)
                whole = "".join(f"{role}\n{text}\n" for role, text in turns)
                rows.append(
                    (row["leaf"], len(turns), _sha(whole), len(learned), _sha(learned), len(formatted))
                )
            columns = zip(*rows) if rows else [[]] * 6
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = [c.split()[0] for c in READ_DDL.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    placed = nodes.repartition("block").sortWithinPartitions("block", "node")
    return placed.mapInArrow(read, READ_DDL)


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def format_conversations(turns, tokenizer, block_tokens=BLOCK_TOKENS):
    """Formats ``turns`` (conv_id, turn, role, text) into prefix trees: (members, nodes), two written tables.

    ``members`` has one row (conv_id, leaf) per conversation, ``nodes`` is ``prefix_trees``. Rows of a conversation are
    ordered by turn (null first), then role and text; repeated rows are turns each. A null role or text is empty; rows
    with a null conv_id are one conversation with a null id. A conversation is one training example, and like one text
    it is held whole by a task, however long its texts; conversations that begin alike, and copies, are not. Other
    columns are not read. An empty table gives two empty tables.
    """
    whole = materialise(whole_conversations(turns), "conversations")
    nodes = materialise(prefix_trees(whole, tokenizer, block_tokens), "chat-nodes")
    return whole.select("conv_id", "leaf"), nodes


def summaries(members, nodes, tokenizer):
    """Per conversation, what is read back from the trees' tokens; see ``read_back``."""
    return members.join(read_back(nodes, tokenizer), "leaf").drop("leaf")


def summaries_sql(extra):
    """The same in SQL from the turns themselves; ``extra`` is a VALUES list of further rows."""
    shown = r"regexp_replace({}, '<(\\*)\|', '<\1\\|', 'g')"
    header = shown.format(r"replace(replace(role, '\', '\\'), chr(10), '\n')")
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM
    (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES {extra}) v)),
  s AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' {order}) AS whole,
    coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '') AS learned,
    sum({len(START) + len(END) + 2} + length({header}) + length({shown.format("text")})) AS formatted
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
  formatted::BIGINT AS formatted_chars FROM s"""
