"""A small table of documents with every awkward case, and helpers of the tests in this folder."""

import hashlib
import re


COLUMNS = ("doc_id long, text string, lang string, source string, n_chars long, key string, text_id string, h int, "
           "component string, kept string, bucket int, spans string, n long, a long, leaf int, total string, host string")
WS = r"[\x20\x09-\x0D]+"
PASSAGE = "the same long passage about rivers and stones that several of these documents share word for word " * 3
LONG = " ".join(f"w{i % 3000}x{i % 7}" for i in range(20000))


def rows():
    texts = [
        None, "", "", "   \t\n ", "one", "one two", "a b c d e", "A b  C\td e", "Zeile mit Ü und ß\nzweite Zeile hier\nzweite Zeile hier",
        PASSAGE, PASSAGE, PASSAGE.upper(), "before " + PASSAGE + " after", PASSAGE.replace("rivers", "lakes", 1), LONG, LONG, LONG + " end",
        "x\ny\nx\nA repeated line of text\n  a REPEATED line of text \n\n", "A repeated line of text\nanother line that is unique",
        "same same same same same same same same", "</s>[INST] ok [/INST] <|endoftext|>", "line\r\nline\r\n\x0b\x0cline", "é" * 400, "  x y z",
    ]
    out = [(i, t, "en" if i % 3 else None, f"src{i % 2}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    out += [out[9], out[9]]                     # repeated rows
    out += [(7, "another text under a used id", "de", "src1", None), (None, "one two", None, None, None), (None, None, None, None, None)]
    return [(*r, "k", "t", 1, "c", "no", 3, "s", 5, 6, 7, "x", "y") for r in out]


def docs(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, COLUMNS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def simple(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def lower(text):
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def order(doc_id):
    return (doc_id is None, doc_id)


def bag(frame, *names):
    return sorted((tuple(r) for r in frame.select(*names).collect()), key=repr)


def is_native(frame):
    """No Python in the plan."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return not re.search(r"Python|Pandas|Arrow", plan)


