"""Text scalar functions as Column expressions: everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Alphabet of the word tokenizer, for texts of Latin and Cyrillic letters without accents.
BASIC_LETTERS = "0-9a-zа-яё"
#: Alphabet for texts in any script.
ALL_LETTERS = r"\p{L}\p{N}"
#: Words that stand for masked entities in queries; "" drops the mark.
PLACEHOLDERS = {"<MONEY>": "деньги", "<DATE>": "дата", "<PHONE>": "телефон", "<URL>": "ссылка", "<ID>": ""}
#: The stop words of the lexical retriever.
STOP_WORDS = (
    "и в во не что он на я с со как а то все она так его но да ты к у же вы за "
    "бы по только ее мне было вот от меня еще нет о из ему теперь когда даже ну вдруг ли "
    "если уже или ни быть был него до вас нибудь опять уж вам ведь там потом себя ничего ей "
    "может они тут где есть надо ней для мы тебя их чем была сам чтоб без будто чего раз тоже "
    "себе под будет ж тогда кто этот того потому этого какой совсем ним здесь этом один почти "
    "мой тем чтобы нее сейчас были куда зачем всех никогда можно при наконец два об другой хоть "
    "после над больше тот через эти нас про всего них какая много разве три эту моя впрочем хорошо "
    "свою этой перед иногда лучше чуть том нельзя такой им более всегда конечно всю между "
    "это также которые который которая которых которой"
).split()
BLANKS = r"(?U)\s+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: what a lambda captures is computed for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def collapse_blanks(text: Column | str) -> Column:
    """Runs of white space, no-break spaces included, become one blank; trimmed; null stays null."""
    return F.trim(F.regexp_replace(F.regexp_replace(_col(text), " ", " "), BLANKS, " "))


def article_links(html: Column | str, pattern: str = r"/articles/(\d+)") -> Column:
    """Distinct linked ids of raw HTML in order of first sight, as array<bigint>."""
    found = F.regexp_extract_all(F.coalesce(_col(html), F.lit("")), F.lit(pattern), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: x.try_cast("bigint")))


def html_to_text_pattern(html: Column | str, drop: Sequence[str] = ("script", "style", "svg", "button")) -> Column:
    """HTML to text by patterns alone: subtrees of ``drop`` go, tags and the commonest references are
    replaced; the parser of :mod:`siftwell.functions.html` is the exact form."""
    text = F.coalesce(_col(html), F.lit(""))
    for tag in drop:
        text = F.regexp_replace(text, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    for ref, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(ref), F.lit(char))
    return collapse_blanks(text)


def substitute_placeholders(text: Column | str, placeholders: Mapping[str, str] = PLACEHOLDERS) -> Column:
    """Each mark becomes its word between blanks (or one blank), in the given order."""
    out = _col(text)
    for mark, word in placeholders.items():
        out = F.replace(out, F.lit(mark), F.lit(f" {word} " if word else " "))
    return out


def word_pattern(letters: str = ALL_LETTERS) -> str:
    return f"([{letters}]+(?:-[{letters}]+)*)"


def raw_tokens(text: Column | str, letters: str = ALL_LETTERS) -> Column:
    """Lower-case words, inner hyphens kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(word_pattern(letters)), F.lit(1))


def tokens(text: Column | str, letters: str = ALL_LETTERS, min_length: int = 2, stop_words: Sequence[str] = STOP_WORDS, placeholders: Mapping[str, str] | None = None, lemma: Column | None = None) -> Column:
    """Filtered tokens: word characters and hyphens only, ``min_length`` at least, no stop words. ``lemma``
    is a map column word -> lemma, applied before the stop words as the last filter repeats the length test."""
    base = substitute_placeholders(text, placeholders) if placeholders else _col(text)
    words = raw_tokens(base, letters)
    if letters not in (BASIC_LETTERS, ALL_LETTERS):  # words of these consist of word characters and hyphens anyway
        words = F.filter(words, lambda w: w.rlike(r"(?U)^[\w\-]+$"))
    if lemma is not None:
        words = F.transform(F.filter(words, lambda w: F.length(w) >= min_length), lambda w: F.coalesce(F.element_at(lemma, w), w))
    # isin over many literals is a hash set
    return F.filter(words, lambda w: (F.length(w) >= min_length) & ~w.isin(*stop_words) if stop_words else F.length(w) >= min_length)


def blank_words(text: Column | str) -> Column:
    """Words between white space (no-break spaces included); none of an empty text."""
    return F.filter(F.split(F.coalesce(_col(text), F.lit("")), BLANKS), lambda w: w != "")


def chunk_count(n_words: Column, size: int, overlap: int, most: int | None) -> Column:
    """How many windows of ``size`` words, ``overlap`` shared, cover ``n_words``."""
    n = F.greatest(F.lit(1), F.ceil((n_words - size) / F.lit(float(size - overlap))) + 1).cast("int")
    n = F.least(n, F.lit(most)) if most is not None else n
    return F.when(n_words == 0, 0).otherwise(n)


def check_window(size: int, overlap: int) -> None:
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("a window needs size > 0 and 0 <= overlap < size")


def word_windows(words: Column, size: int = 400, overlap: int = 100, most: int | None = 40) -> Column:
    """array<array<string>>: the windows of a word array."""
    check_window(size, overlap)

    def cut(w: Column) -> Column:
        n = chunk_count(F.size(w), size, overlap, most)
        steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(steps, lambda i: F.slice(w, i * (size - overlap) + 1, size))

    return bind(words, cut)


def chunks(body: Column | str, title: Column | str | None = None, size: int = 400, overlap: int = 100, most: int | None = 40, prefix: bool = True) -> Column:
    """Chunk texts, each led by ``title. ``; an empty body gives the title alone, both empty give none."""
    head = F.trim(F.coalesce(_col(title), F.lit(""))) if title is not None else F.lit("")
    lead = F.when((head != "") & F.lit(prefix), F.concat(head, F.lit(". "))).otherwise("")
    made = F.transform(word_windows(blank_words(body), size, overlap, most), lambda w: F.concat(lead, F.array_join(w, " ")))
    return bind(made, lambda m: F.when(F.size(m) > 0, m).when(head != "", F.array(head)).otherwise(F.array().cast("array<string>")))


def word_ngrams(word: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams of the word between two blanks; lengths beyond the padded word give none."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    size = F.length(padded)
    return F.flatten(
        F.transform(
            F.sequence(F.lit(low), F.lit(high)),
            lambda n: F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(padded, i, n))).otherwise(F.array().cast("array<string>")),
        )
    )


def stratum(n_labels: Column) -> Column:
    return F.when(n_labels <= 1, "1").when(n_labels == 2, "2").otherwise("3+")


def length_bin(n_words: Column) -> Column:
    """Bins (0,7], (7,12], (12,20], (20,...)."""
    return F.when(n_words <= 7, "1-7").when(n_words <= 12, "8-12").when(n_words <= 20, "13-20").otherwise("21+")


def hashing_embedding(text: Column | str, dim: int = 64) -> Column:
    """array<double>[dim]: L2-normalised counts of words by crc32 mod dim (seed 0); zero without words."""
    slots = F.transform(raw_tokens(text), lambda w: (F.crc32(w.cast("binary")) % dim).cast("int"))
    counts = bind(slots, lambda own: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(own, lambda s: s == i)).cast("double")))
    return unit(counts)


def unit(vector: Column) -> Column:
    """array<double> of length 1; zero stays zero."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return bind(vector, lambda v: bind(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two numeric arrays, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
