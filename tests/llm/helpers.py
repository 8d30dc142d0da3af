"""Small tables with the rows that break things, and brute-force answers."""
import json
import os

import pyarrow as pa
import pyarrow.parquet as pq

DOC_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()),
                        ("n_chars", pa.int64()),
                        # names that the operators use themselves
                        ("score", pa.float64()), ("run", pa.int64()), ("size", pa.string()), ("kept", pa.string()),
                        ("toxicity", pa.string()), ("ids", pa.string()), ("fp", pa.int64())])

TRICKY = ["", None, " ", "\n\t ", "a", "one  two   three", " leading and trailing ", "tab\tsep\nline\r\nend",
          "don't I'll we're 'quoted' it's", "<|endoftext|> inside <|endoftext|>", "x<|startoftext|>y", "\x01 \x01\x01 mark \x01",
          "naïve café straße ÀÉÎ ﬁ Ⅷ", "é ä combining", "İstanbul ΣΑΣ", "日本語のテキスト と 空白", "👍🏽 emoji 🎉🎉",
          "12,345.67 3.14 1e10", "a b c​d᠎e", "UPPER lower MiXeD", "....!!!???", "word.", "a, b; c: d!",
          "nul\x00char", "\x1c\x1d sep", "ª º µ ß", "x" * 3000, "y " * 3000, ("abc " * 40 + "\n") * 60]


def doc(i, text, lang="en", source="s1"):
    return {"doc_id": i, "text": text, "lang": lang, "source": source, "n_chars": len(text or ""), "score": 0.5, "run": 3,
            "size": "z", "kept": "k", "toxicity": "t", "ids": "i", "fp": 1}


def odd_documents():
    """Nulls in any column, empty and long texts, ties, repeated rows."""
    rows = [doc(i, t, lang=["en", None, "de"][i % 3], source=["s2", None, "s1", ""][i % 4]) for i, t in enumerate(TRICKY)]
    rows += [doc(100, "the same text"), doc(101, "the same text"), doc(101, "the same text"), doc(102, "the same text", source=None)]
    rows += [doc(None, "no id here"), doc(None, "no id here"), doc(None, "the same text")]
    rows += [doc(200 + i, f"filler words number {i} and some more words to make it longer {i * 7}") for i in range(30)]
    return rows


def write(folder, name, rows, schema):
    os.makedirs(folder, exist_ok=True)
    pq.write_table(pa.Table.from_pylist(rows, schema=schema), f"{folder}/{name}.parquet")


LABEL_SCHEMA = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])
VECTOR_SCHEMA = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())])
BENCH_SCHEMA = pa.schema([("item_id", pa.int64()), ("text", pa.string())])
PAGE_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("text", pa.string())])


CONV_SCHEMA = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()),
                         ("at", pa.string()), ("first", pa.int64()), ("action", pa.string())])


def odd_turns():
    """Nulls in any column, ties, repeated rows, odd texts."""
    rows = [(None, 0, "user", None), (None, None, None, "z"), (1, None, "user", "z"), (1, 0, "assistant", ""), (1, 0, "assistant", ""),
            (2, -5, "system", "s"), (2, 7, "tool", "t" * 20000), (3, 1, "", " ")] + [(4, i % 3, TRICKY[i], TRICKY[i]) for i in range(len(TRICKY))]
    return [dict(zip(CONV_SCHEMA.names, (*r, "x", 5, "y"))) for r in rows]


def write_all(folder, docs, labels=(), vectors=(), pages=(), turns=()):
    write(folder, "conversations", list(turns), CONV_SCHEMA)
    write(folder, "documents", list(docs), DOC_SCHEMA)
    write(folder, "labels", list(labels), LABEL_SCHEMA)
    write(folder, "embeddings", list(vectors), VECTOR_SCHEMA)
    write(folder, "pages", list(pages), PAGE_SCHEMA)
    write(folder, "benchmark", [{"item_id": i, "text": d["text"]} for i, d in enumerate(list(docs)[::7])], BENCH_SCHEMA)
    return str(folder)


def frozen(rows):
    return sorted(json.dumps(r.asDict(), sort_keys=True, default=str) for r in rows)
