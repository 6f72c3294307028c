"""Text functions as column expressions: clean-up, tokens, question classes, truncation, scores of form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode strip, a paragraph that is more than a separator, what a word token may hold.
STRIP = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
SUBSTANCE = r"[^_\-=. \t\n]"
PLAIN = r"[^_\-=.\s\p{Z}]"  # what no stripping takes away
NOT_WORD = r"[^a-z0-9\p{L}\p{M}\p{N}]++"
WORD_OR_SPACE = r"[\p{L}\p{M}\p{N}]+|\s+"
#: Thai digits and their ASCII forms; the answer's label.
THAI_DIGITS, DIGITS = "๐๑๒๓๔๕๖๗๘๙", "0123456789"
ANSWER_LABEL = r"^\s*คำตอบ\s*[:：]\s*"
#: Question classes in order of precedence, by keywords.
QUESTION_CLASSES = [
    ("why", ["why", "because", "pourquoi", "warum", "por qué", "ทำไม", "เพราะ"]),
    ("how", ["how", "comment", "wie ", "cómo", "อย่างไร"]),
    ("when", ["when", "quand", "wann", "cuándo", "เมื่อ"]),
    ("where", ["where", "où", "wo ", "dónde", "ที่ไหน"]),
    ("who", ["who", "qui ", "wer ", "quién", "ใคร"]),
    ("count", ["how many", "combien", "wie viele", "cuánto", "กี่", "เท่าไร"]),
    ("what", ["what", "that", "que", "was ", "qué", "อะไร"]),
]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, STRIP, "")


def is_valid_paragraph(text: Column) -> Column:
    """More than white space and separator characters."""
    return F.coalesce(text.rlike(PLAIN) | strip(text).rlike(SUBSTANCE), F.lit(False))


def words(text: Column) -> Column:
    """Lower-case runs of letters, their marks and digits. Any function from text to an array of tokens can stand in for it."""
    return F.array_remove(F.split(F.lower(text), NOT_WORD), "")


def spoken(text: Column) -> Column:
    """The words with one space between them; no word, no text."""
    return F.trim(F.regexp_replace(F.lower(text), NOT_WORD, " "))


def words_and_spaces(text: Column) -> Column:
    """Like words, with the white space between them as tokens of their own."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_OR_SPACE), F.lit(0))


def spaced_tokens(tokens: Column) -> Column:
    """Tokens joined and split again, so that no tokens become one empty token."""
    return F.split(F.array_join(tokens, " "), " ")


def fold_digits(text: Column) -> Column:
    return F.translate(text, THAI_DIGITS, DIGITS)


def strip_answer_label(text: Column) -> Column:
    return F.regexp_replace(text, ANSWER_LABEL, "")


def truncate_words(tokens: Column, n: int) -> Column:
    return F.array_join(F.slice(tokens, 1, n), " ")


def cut_content_words(tokens: Column, n: int) -> Column:
    """The text of tokens and the blanks between them up to the n-th token that is no blank, blanks at the ends stripped; shorter texts as they are, stripped."""
    spoken = F.filter(F.transform(tokens, lambda t, i: F.when(strip(t) != "", i)), lambda i: i.isNotNull())
    past = F.get(spoken, F.lit(n))  # where the first word that is too many stands
    return strip(F.array_join(F.slice(tokens, F.lit(1), F.coalesce(past, F.size(tokens))), ""))


def truncate_chars(text: Column, n: int, mark: str = "") -> Column:
    """The first n code points; with a mark, cut texts lose trailing blanks and end in it."""
    if not mark:
        return F.substring(text, 1, n)
    return F.when(F.length(text) > n, F.concat(F.rtrim(F.substring(text, 1, n)), F.lit(mark))).otherwise(text)


def truncate_sentences(text: Column, n: int) -> Column:
    """The first n lines; a sentence segmenter can be put in front."""
    return F.array_join(F.slice(F.split(text, "\n"), 1, n), "\n")


def question_class(text: Column) -> Column:
    """The first class one of whose keywords occurs, else other."""
    low, found = F.lower(text), F.lit("other")
    for name, keys in reversed(QUESTION_CLASSES):
        any_key = F.lit(False)
        for k in keys:
            any_key = any_key | F.contains(low, F.lit(k))
        found = F.when(any_key, F.lit(name)).otherwise(found)
    return found


def factoid_kind(text: Column) -> Column:
    kind = question_class(text)
    return F.when(kind.isin("when", "where", "who", "count"), F.lit("factoid")).when(kind.isin("why", "how"), F.lit("explanation")).otherwise(F.lit("other"))


def has_digit(text: Column) -> Column:
    return text.rlike(r"\p{Nd}")


#: Words that tell what kind of answer a question asks for.
KEYWORDS = {
    "list": ["ประกอบด้วย", "มีอะไรบ้าง", "ได้แก่"],
    "summary": ["สรุป", "สาระสำคัญ", "ประเด็น"],
    "who": ["ใคร", "ผู้ใด"],
    "what": ["อะไร"],
    "how": ["อย่างไร"],
}


def keyword_flags(text: Column, keywords: dict[str, list[str]] | None = None) -> Column:
    """A struct of booleans, one a name: whether any of its words occurs."""
    found = lambda words: F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(text, w))
    return F.struct(*(F.coalesce(found(words), F.lit(False)).alias(f"has_{name}") for name, words in (keywords or KEYWORDS).items()))


def restate_score(answer: Column, question: Column) -> Column:
    """Of the answer's first five tokens those among the question's first five, always over five."""
    head = F.slice(question, 1, 5)
    return F.size(F.filter(F.slice(answer, 1, 5), lambda t: F.array_contains(head, t))) / F.lit(5.0)


def length_score(n: Column, ideal: float) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.abs(n - F.lit(ideal)) / F.lit(ideal))


def candidate_score(restate: Column, length: Column, frequency: Column, centrality: Column, weights=(0.40, 0.30, 0.15, 0.15)) -> Column:
    return sum((w * c for w, c in zip(weights, (restate, length, frequency, centrality), strict=True)), F.lit(0.0))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(z, F.lit(50.0)), F.lit(-50.0))))
