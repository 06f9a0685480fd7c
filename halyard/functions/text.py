"""Text functions. Columns wherever Spark's own functions reach; Arrow UDFs only for edit distance with transpositions and for codes."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accents that filters fold, and those that search folds.
FILTER_ACCENTS = ("áéíóúüñ", "aeiouun")
SEARCH_ACCENTS = ("áàäâéèëêíìïîóòöôúùüûñÁÀÄÂÉÈËÊÍÌÏÎÓÒÖÔÚÙÜÛÑ", "aaaaeeeeiiiioooouuuunaaaaeeeeiiiioooouuuun")
#: Replacements of the Romance phonetic key, in order.
PHONETIC = (("sh", "x"), ("ch", "x"), ("tch", "x"), ("sw", "s"), ("ll", "y"), ("qu", "k"), ("ce", "se"), ("ci", "si"), ("ge", "je"), ("gi", "ji"), ("v", "b"), ("z", "s"), ("c", "k"), ("h", ""), ("nt", "t"))
#: Replacements before the phonetic key that give the two metaphone-like codes.
METAPHONE_FIRST = (("sch", "x"), ("sh", "x"), ("ch", "x"), ("ph", "f"), ("gh", "k"), ("kn", "n"), ("wr", "r"), ("ck", "k"), ("dg", "j"), ("w", "v"), ("z", "s"))
METAPHONE_SECOND = (("sch", "sk"), ("ch", "k"), ("ph", "f"))


def fold(c: Column) -> Column:
    """Lower case without the accents that filters fold."""
    return F.translate(F.lower(c), *FILTER_ACCENTS)


def fold_search(c: Column) -> Column:
    """ASCII lower case without the accents that search folds."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, SEARCH_ACCENTS[0] + upper, SEARCH_ACCENTS[1] + upper.lower())


def py_fold(s: str) -> str:
    return s.lower().translate(str.maketrans(*FILTER_ACCENTS))


def py_fold_search(s: str) -> str:
    s = s.translate(str.maketrans(*SEARCH_ACCENTS))
    return "".join(c.lower() if c.isascii() else c for c in s)


def _replaced(c, pairs):
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def phonetic(c: Column) -> Column:
    """Romance phonetic key: replacements, then upper-case consonants and digits, runs collapsed."""
    c = _replaced(fold_search(c), PHONETIC)
    return F.upper(F.regexp_replace(F.regexp_replace(c, "[^b-df-hj-np-tv-z0-9]", ""), r"(.)\1+", "$1"))


def metaphone(c: Column) -> Column:
    """struct<first, second> of metaphone-like codes."""
    c = fold_search(c)
    return F.struct(phonetic(_replaced(c, METAPHONE_FIRST)).alias("first"), phonetic(_replaced(c, METAPHONE_SECOND)).alias("second"))


def py_phonetic(s: str) -> str:
    s = py_fold_search(s)
    for a, b in PHONETIC:
        s = s.replace(a, b)
    s = re.sub("[^b-df-hj-np-tv-z0-9]", "", s)
    return re.sub(r"(.)\1+", r"\1", s).upper()


def py_metaphone(s: str) -> tuple[str, str]:
    out = []
    for pairs in (METAPHONE_FIRST, METAPHONE_SECOND):
        x = py_fold_search(s)
        for a, b in pairs:
            x = x.replace(a, b)
        out.append(py_phonetic(x))
    return out[0], out[1]


def trigrams(c: Column) -> Column:
    """Sorted distinct trigrams of the folded text between two spaces and one; empty for blank text."""
    return ngram_set(F.concat(F.lit("  "), fold(F.trim(c)), F.lit(" ")), 3, F.trim(c) != "")


def ngram_set(c: Column, n: int, where: Column | None = None) -> Column:
    size = F.length(c) - (n - 1)
    ok = (size > 0) if where is None else (size > 0) & where
    return F.when(ok, F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.substr(c, i, F.lit(n)))))).otherwise(F.array().cast("array<string>"))


def ngrams_2_3(c: Column) -> Column:
    """Sorted distinct two- and three-grams of a token."""
    return F.array_sort(F.array_union(ngram_set(c, 2), ngram_set(c, 3)))


def py_trigrams(s: str) -> set[str]:
    s = py_fold(s.strip())
    return {f"  {s} "[i : i + 3] for i in range(len(s) + 1)} if s else set()


def py_ngrams(s: str) -> list[str]:
    return sorted({s[i : i + n] for n in (2, 3) for i in range(len(s) - n + 1)})


def overlap_ratio(a: Column, b: Column) -> Column:
    """Share of ``a``'s elements that ``b`` has; 0 for an empty ``a``."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(a)), F.lit(0.0))


def tokens_search(c: Column) -> Column:
    """Search tokens: folded, cut at anything but ASCII letters and digits, of two characters or more."""
    return F.filter(F.split(fold_search(c), "[^a-z0-9]+"), lambda t: F.length(t) >= 2)


def py_tokens_search(s: str) -> list[str]:
    return [t for t in re.split("[^a-z0-9]+", py_fold_search(s)) if len(t) >= 2]


def tokens_fuzzy(c: Column) -> Column:
    """Tokens of the fuzzy matcher: folded, cut at white space and ``- _ . #``."""
    return F.filter(F.split(fold(c), r"[\s\-_.#]+"), lambda t: t != "")


def osa(a: str, b: str, most: int | None = None) -> int:
    """Edit distance where swapping two neighbours is one edit; with ``most``, anything above may come back as most + 1."""
    if most is not None and abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + (x != y))
            row.append(best)
        if most is not None and min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def edit_distance(a: Column, b: Column) -> Column:
    """Optimal string alignment distance of two columns; null if either is null."""

    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else osa(p, q) for p, q in zip(x, y, strict=True)], dtype="Int32")

    return run(a, b)


def py_code(raw: str) -> str:
    """A code without separators, upper case, with O as 0 and I or L as 1 beside digits or from a word's third place on."""
    out, digit_anywhere = [], any(c in "0123456789" for c in raw)
    for word in raw.split():
        chars = [c for c in word if c.isascii() and c.isalnum()]
        has_digit = any(c in "0123456789" for c in word)
        for i, c in enumerate(chars):
            beside = (i > 0 and chars[i - 1].isdigit()) or (i + 1 < len(chars) and chars[i + 1].isdigit())
            swap = has_digit and (i >= 2 or beside) or digit_anywhere and len(chars) <= 4 and beside
            out.append({"O": "0", "I": "1", "L": "1"}.get(c.upper(), c.upper()) if swap else c.upper())
    return "".join(out)


def canonical_code(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else py_code(x))

    return run(c)


class FuzzyTerm:
    """A search term made ready to be matched with many values."""

    def __init__(self, term: str):
        self.text = py_fold(term.strip())
        words = self.text.split()
        self.parts = [self._part(self.text)] if self.text else []
        self.words = [self._part(w) for w in words] if len(words) > 1 else []

    @staticmethod
    def _part(t: str):
        code = py_code(t) if len(t) >= 2 else ""
        most = 0 if len(t) <= 2 else 1 if len(t) <= 8 else 2
        return t, code if len(code) >= 2 else "", any(c in "0123456789" for c in t), py_trigrams(t), most, py_phonetic(t) if len(t) >= 4 else ""

    @staticmethod
    def _one(part, value, low, toks) -> bool:
        t, code, digit, grams, most, sound = part
        if t in low or code and code in py_code(value):
            return True
        if digit:
            return False
        if grams and len(grams & py_trigrams(low)) / len(grams) >= 0.75:
            return True
        if not most:
            return False
        for tok in toks:
            d = osa(tok, t, 2)
            if d <= most or sound and d <= 2 and py_phonetic(tok) == sound:
                return True
        return False

    def matches(self, value: str | None) -> bool:
        if not value or not self.parts:
            return False
        low = py_fold(value)
        toks = [x for x in re.split(r"[\s\-_.#]+", low) if x]
        if self._one(self.parts[0], value, low, toks):
            return True
        return bool(self.words) and all(self._one(w, value, low, toks) for w in self.words)


def fuzzy_match(c: Column, term: str) -> Column:
    """Whether a value holds a term approximately: as a substring, a code, by trigrams, by edit distance or by sound. Null and blank never match."""
    ready = FuzzyTerm(term or "")

    @F.pandas_udf("boolean")
    def slow(s: pd.Series) -> pd.Series:
        # values repeat, so each distinct one is matched once a batch
        codes, uniques = pd.factorize(s, use_na_sentinel=True)
        hit = np.array([ready.matches(x) for x in uniques] + [False])
        return pd.Series(hit[codes])

    if not ready.text:
        return F.lit(False)
    return F.coalesce(F.when(F.contains(fold(c), F.lit(ready.text)), F.lit(True)).otherwise(slow(c)), F.lit(False))


def label(template: str, columns: list[str], types: dict[str, str]) -> Column:
    """``{{name}}`` filled from columns: null as nothing, whole numbers without fraction, others with two digits."""
    parts, at = [], 0
    for m in re.finditer(r"\{\{([^}]+)\}\}", template):
        parts.append(F.lit(template[at : m.start()]))
        name = m[1].strip()
        found = next((c for c in (name, name.rsplit("/", 1)[-1]) if c in columns), None)
        if found is None and "." in name and name.split(".")[0] in columns:
            c = F.col(name)
            kind = types.get(name, "string")
        else:
            c, kind = (F.col(f"`{found}`"), types[found]) if found else (F.lit(None).cast("string"), "string")
        parts.append(F.coalesce(shown(c, kind), F.lit("")))
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def shown(c: Column, kind: str) -> Column:
    """A value as labels and CSV cells show it."""
    if kind in ("double", "float") or kind.startswith("decimal"):
        d = c.cast("double")
        return F.when(d == F.floor(d), F.floor(d).cast("string")).when(d.isNotNull(), F.format_string("%.2f", d))
    return c.cast("string")


def padded_code(prefix: str, number: Column, width: int = 4, segment: str | None = None) -> Column:
    """``prefix[-segment]-NNNN``; numbers that need more places keep them."""
    text = number.cast("string")
    return F.concat(F.lit(f"{prefix}-{segment}-" if segment else f"{prefix}-"), F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0")))


def deletes(word: str, most: int = 2) -> list[str]:
    """The word with up to ``most`` characters left out; words of two characters or fewer lose none."""
    seen, level = {word}, [word]
    for _ in range(most):
        level = sorted({w[:i] + w[i + 1 :] for w in level if len(w) > 2 for i in range(len(w))} - seen)
        seen.update(level)
    return sorted(seen)
