"""Chat formatting on the level of tokens: segments are encoded one by one and reserved ids spliced in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verba.llm.common import worker_cache

# The template's control strings, in the order of their reserved ids (fixed values).
CONTROL = ("<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[TURN]", "[/TURN]")
# Role -> (opening, closing) control string. A role outside this list opens with [TURN], followed by its
# name and a line feed.
ROLES = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[TURN]", "[/TURN]")
BASE = 50257  # first reserved id: the byte vocabulary uses 0..50255, its end mark 50256
SEGMENT = "ids binary, loss binary, n_chars long"


def escape(text: str) -> str:
    r"""Control strings in a text get a backslash after their bracket; one that has backslashes there
    already gets one more, so that unescape() restores every text. The result holds no control string."""
    import re

    return re.sub(r"([<\[])(?=\\*(?:/?s>|/?(?:SYS|INST|TURN)\]))", r"\1" + "\\\\", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    import re

    return re.sub(r"([<\[])\\(?=\\*(?:/?s>|/?(?:SYS|INST|TURN)\]))", r"\1", text) if "\\" in text else text


def role_head(role: str) -> str:
    """The first line of a turn whose role has no control strings of its own."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"


def head_role(line: str) -> str:
    import re

    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(line))


def byte_codec(path: str):
    """(encode, decode) of a byte-level vocabulary: text -> ids, ids -> bytes. Lossless."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return own.encode_ordinary, own.decode_bytes


def format_turns(turns: DataFrame, vocabulary: str, role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: its columns and ``segment`` (ids: little-endian unsigned 32-bit; loss: a byte
    per id; n_chars: code points of its formatted text). A null text is empty, a null role is named "";
    a column of ``turns`` that is called segment is replaced.

    A turn is [opening id] text ids [closing id]; reserved ids never come out of a text, whose control
    strings are escaped besides, so that the formatted string marks turns as well as the ids do. The
    loss mask covers an assistant's text and its closing id. It comes from a prefix sum over +1 where
    the covered range opens and -1 where it ends. Turns are encoded apart: no shuffle."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf(SEGMENT)
    def encode(role, text):
        import numpy as np
        import pandas as pd

        enc, _ = worker_cache(f"bytes:{vocabulary}", lambda: byte_codec(vocabulary))
        out = []
        for r, t in zip(role, text, strict=True):
            r, t = r or "", escape(t or "")
            first, last = ROLES.get(r, OTHER)
            head = "" if r in ROLES else role_head(r)
            own = enc(head) if head else []
            body = enc(t)
            ids = np.array([BASE + CONTROL.index(first), *own, *body, BASE + CONTROL.index(last)], dtype="<u4")
            step = np.zeros(len(ids) + 1, dtype=np.int8)
            if r == "assistant":
                step[1] += 1
                step[len(ids)] -= 1
            out.append((ids.tobytes(), np.cumsum(step)[:-1].astype(np.uint8).tobytes(), len(first) + len(head) + len(t) + len(last)))
        return pd.DataFrame(out, columns=["ids", "loss", "n_chars"])

    return turns.withColumn("segment", encode.asNondeterministic()(F.col(f"`{role_col}`"), F.col(f"`{text_col}`")))


def format_conversations(turns: DataFrame, vocabulary: str, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: its id, ids and loss (the segments of its turns, by turn; equal turns by
    role, then text, nulls first) and n_chars. Turns are encoded where they are read; then a
    conversation's segments meet, which a row for each conversation asks for. A null conv_id is a
    conversation too; repeated rows are turns of their own. Empty table: no rows."""
    own = turns.select(turns[f"`{conv_col}`"].alias("_c"), turns[f"`{turn_col}`"].alias("_n"),
                       turns[f"`{role_col}`"].alias("_r"), turns[f"`{text_col}`"].alias("_x"))
    seg = format_turns(own, vocabulary, "_r", "_x").select("_c", F.struct("_n", "_r", "_x", "segment").alias("s"))
    by = seg.groupBy("_c").agg(F.sort_array(F.collect_list("s")).alias("t"))
    join = lambda part: F.expr(f"unhex(array_join(transform(t, x -> hex(x.segment.{part})), ''))")
    return by.select(F.col("_c").alias(conv_col), join("ids").alias("ids"), join("loss").alias("loss"),
                     F.expr("aggregate(t, 0L, (a, x) -> a + x.segment.n_chars)").alias("n_chars"))


def read_back(formatted: DataFrame, vocabulary: str) -> DataFrame:
    """Add ``turns`` (array of role, text), ``loss_text`` (all text under the mask) and ``formatted`` (the
    string) as decoded and unescaped from ids and loss alone."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("turns array<struct<role: string, text: string>>, loss_text string, formatted string")
    def decode(ids, loss):
        import numpy as np
        import pandas as pd

        _, dec = worker_cache(f"bytes:{vocabulary}", lambda: byte_codec(vocabulary))
        opens = {v: k for k, v in ROLES.items()}
        out = []
        for raw, mask in zip(ids, loss, strict=True):
            x, m = np.frombuffer(raw, dtype="<u4"), np.frombuffer(mask, dtype=np.uint8)
            turns, under, string = [], [], []
            marks = np.flatnonzero(x >= BASE)
            for a, b in zip(marks[::2], marks[1::2], strict=True):
                pair = CONTROL[x[a] - BASE], CONTROL[x[b] - BASE]
                body = dec(x[a + 1: b].tolist()).decode()
                string += [pair[0], body, pair[1]]
                if pair == OTHER:
                    role, _, body = body.partition("\n")
                    turns.append((head_role(role), unescape(body)))
                else:
                    turns.append((opens[pair], unescape(body)))
                covered = m[a + 1: b].astype(bool)
                if covered.any():
                    under.append(unescape(dec(x[a + 1: b][covered].tolist()).decode()))
            out.append(([{"role": r, "text": t} for r, t in turns], "".join(under), "".join(string)))
        return pd.DataFrame(out, columns=["turns", "loss_text", "formatted"])

    return formatted.withColumn("_d", decode.asNondeterministic()("ids", "loss")).select(*formatted.columns, "_d.*")
