"""Small tables that every operator has to bear, and plain versions of what they compute."""

import re
import string

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return _WORD.findall((text or "").translate(_LOWER))


def frame(spark, texts, ids=None, extra=False):
    """A documents table; with `extra`, columns whose names clash with those that operators make."""
    rows = [(k if ids is None else ids[k], x, "en", "s", None if x is None else len(x)) for k, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS)
    if extra:
        for name in ("n", "digest", "ids", "at", "id", "root", "band", "side", "block", "slice", "part", "line", "n_lines", "lang_pred", "content", "media", "key", "rule", "score"):
            docs = docs.selectExpr("*", f"'x' AS `{name}`")
    return docs


#: Null, empty, blank, one word, repeated rows, a long text, other scripts, controls, and strings of added tokens.
HARD = [
    None, "", " \t\n\r\x0b\x0c ", "a", "the cat sat on the mat and ran", "the cat sat on the mat and ran", "x" * 30000, ("word " * 20000).strip(),
    "Ünïcödé ΣΑΣ İstanbul é 한 日本語テキスト مرحبا 👍🏽", "a\x1cb\x1f \x85  x", "<|endoftext|> in <|startoftext|>text", "1234567890 ... !!! 's 'tis don't",
    "\n\nfirst line here\n\nsecond line here\n", "\x00\x01BM\x89PNG RIFF", "a b c d",
]
