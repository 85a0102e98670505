"""Text functions as Column expressions: normal form, words, similarity."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folds() -> tuple[str, str]:
    """Accented Latin letters and their bases, by canonical decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in (*range(0xC0, 0x180), *range(0x1CD, 0x1DD), *range(0x1E00, 0x1F00)) if len(unicodedata.normalize("NFD", chr(c))) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _folds()

#: Portuguese words that carry no content.
STOPWORDS = frozenset(
    (
        "a o as os um uma uns umas de do da dos das d em no na nos nas num numa por pelo pela pelos pelas para pra pro pros pras "
        "com sem sob sobre ate apos entre contra desde e ou mas porem que se como quando onde qual quais quem cujo cuja "
        "este esta estes estas isto esse essa esses essas isso aquele aquela aqueles aquelas aquilo "
        "eu tu ele ela nos vos eles elas me te lhe lhes meu minha meus minhas teu tua seu sua seus suas nosso nossa nossos nossas "
        "ao aos a as e foi era sao ser sera sendo sido ter tem tinha tenho temos ha havia esta estao estava estar estou "
        "ja nao sim muito muita muitos muitas mais menos tambem so bem ainda cada todo toda todos todas outro outra outros outras "
        "mesmo mesma la aqui ai entao pois porque assim etc tal tais algum alguma alguns algumas nenhum nenhuma qualquer "
        "voce voces vc vcs gente favor pode podem poderia deve devem sobre seja sejam fazer faz feito vai vou vamos "
        "quero queria gostaria preciso precisa oi ola ne tipo coisa coisas aquela dela dele deles delas nele nela lo la los las"
    ).split()
)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def fold(c: Column) -> Column:
    """Lower case without accents; null stays null."""
    return F.regexp_replace(F.lower(F.translate(c, ACCENTED, PLAIN)), "[̀-ͯ]", "")


def norm(c: Column) -> Column:
    """Folded, with plain quotes, single spaces and no space around; null becomes empty."""
    plain = F.translate(fold(F.coalesce(c.cast("string"), F.lit(""))), "“”«»‘’", "\"\"\"\"''")
    return F.trim(F.regexp_replace(plain, r"[\s ]+", " "))


def slug(c: Column, length: int = 48) -> Column:
    """Folded words joined by hyphens, ``length`` characters at most; empty becomes item."""
    hyphens = F.regexp_replace(F.regexp_replace(norm(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.substring(hyphens, 1, length)
    return F.when(cut == "", F.lit("item")).otherwise(cut)


def capitalised(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def title_case(c: Column) -> Column:
    """First letters in upper case, small Portuguese words in lower case, acronyms as they are."""
    small = [F.lit(x) for x in "de da do das dos e em a o para com por na no".split()]
    word = lambda w, i: F.when((i > 0) & F.lower(w).isin(*small), F.lower(w)).when(w.rlike("^[A-Z0-9-]{2,}$"), w).otherwise(capitalised(F.lower(w)))
    return F.array_join(F.transform(F.split(F.coalesce(c, F.lit("")), r"\s+"), word), " ")


def truncated(c: Column, n: int) -> Column:
    """At most ``n`` characters, the last an ellipsis where something was cut."""
    return F.when(F.length(c) > n, F.concat(F.rtrim(F.substring(c, 1, n - 1)), F.lit("…"))).otherwise(c)


def listed(items: Column, last: str = "e") -> Column:
    """Non-blank items joined by commas, the last by a word."""
    full = F.filter(items, lambda x: x.isNotNull() & (x != ""))
    n = F.size(full)
    return F.when(n <= 1, F.array_join(full, "")).otherwise(F.concat(F.array_join(F.slice(full, F.lit(1), n - 1), ", "), F.lit(f" {last} "), F.element_at(full, -1)))


def escaped(c: Column) -> Column:
    """Markup characters as entities."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


#: The quotes, blanks and marks that are stripped from names, and the separators of lists.
def clean_name(c: Column) -> Column:
    """Without quotes and blanks around and marks behind, white space as single blanks; null is empty."""
    ends = F.regexp_replace(F.coalesce(c, F.lit("")), r"^[\s\"“'«]+|[\s\"”'».,;:!?]+$", "")
    return F.trim(F.regexp_replace(ends, r"\s+", " "))


def quoted(c: Column) -> Column:
    """The first text of 2 to 60 characters within quotes, else null."""
    return F.nullif(F.trim(F.regexp_extract(c, r"[\"“'«]([^\"”'»]{2,60})[\"”'»]", 1)), F.lit(""))


def split_list(c: Column) -> Column:
    """Names separated by commas, semicolons, line breaks or the word e; names of 50 characters or more are none."""
    names = F.transform(F.split(F.coalesce(c, F.lit("")), r"\s*(?:[,;\n]|\se\s)\s*"), clean_name)
    return F.filter(names, lambda x: (x != "") & (F.length(x) < 50))


def highlighted(c: Column, query: Column) -> Column:
    """The text with every word of three characters or more in bold whose stem the query has."""
    wanted = F.transform(content_words(query), stem)
    parts = F.regexp_extract_all(c, F.lit(r"(?s)[A-Za-zÀ-ÿ0-9-]{3,}|."), F.lit(0))
    hit = lambda w: (F.length(w) >= 3) & F.array_contains(wanted, stem(norm(w)))
    return F.array_join(F.transform(parts, lambda w: F.when(hit(w), F.concat(F.lit("**"), w, F.lit("**"))).otherwise(w)), "")


def words(c: Column) -> Column:
    """Folded words, hyphenated ones whole."""
    return F.regexp_extract_all(norm(c), F.lit("[a-z0-9]+(?:-[a-z0-9]+)*"), F.lit(0))


def content_words(c: Column) -> Column:
    """Words without stop-words and single characters; norm ids in one word."""
    kept = F.filter(words(c), lambda w: ~w.isin(*sorted(STOPWORDS)) & (F.length(w) > 1))
    return F.transform(kept, lambda w: F.when(w.rlike(r"^nr-?\d+$"), F.replace(w, F.lit("-"), F.lit(""))).otherwise(w))


#: Fixed values of the light stemmer: plural endings with the ending that replaces them and the least
#: length, then suffixes, of which the first that leaves three letters is cut.
PLURALS = (("oes", "ao", 4), ("aes", "ao", 4), ("ais", "al", 4), ("eis", "el", 6), ("ois", "ol", 4), ("ns", "m", 4), ("res", "r", 6), ("zes", "z", 6), ("les", "l", 6))
SUFFIXES = tuple("amente mente acoes icoes acao icao ucao cao idades idade ismos ismo istas ista aveis avel iveis ivel adoras adores adora ador amentos amento imentos imento ancias ancia encias encia ando endo indo ados adas idos idas ado ada ido ida aria eria eiro eira ar er ir ao o a e".split())


def stem(w: Column) -> Column:
    """Light Portuguese stem of a folded word; short words and words with digits stay."""
    plural = None
    for end, to, least in PLURALS:
        case = w.endswith(end) & (F.length(w) >= least)
        value = F.concat(F.substring(w, F.lit(1), F.length(w) - len(end)), F.lit(to))
        plural = F.when(case, value) if plural is None else plural.when(case, value)
    single = plural.when(w.rlike("[^s]s$") & (F.length(w) > 3), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
    cut = lambda x: F.coalesce(*[F.when(x.endswith(s) & (F.length(x) >= len(s) + 3), F.substring(x, F.lit(1), F.length(x) - len(s))) for s in SUFFIXES], x)
    return F.when((F.length(w) <= 3) | w.rlike(r"\d"), w).otherwise(let(single, cut))


def stem_of(w: str) -> str:
    """``stem`` of one word, for tasks that stem each word of a batch once."""
    if len(w) <= 3 or re.search(r"[0-9]", w):
        return w
    for end, to, least in PLURALS:
        if w.endswith(end) and len(w) >= least:
            w = w[: -len(end)] + to
            break
    else:
        w = w[:-1] if re.search("[^s]s$", w) else w
    return next((w[: -len(s)] for s in SUFFIXES if w.endswith(s) and len(w) >= len(s) + 3), w)


def token_of(w: str) -> str | None:
    """The stem of a content word, norm ids in one word; null for stop-words and single characters."""
    if w in STOPWORDS or len(w) < 2:
        return None
    return w.replace("-", "") if re.fullmatch(r"nr-?[0-9]+", w) else stem_of(w)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def _bigrams(s: Column) -> Column:
    return F.when(F.length(s) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(2))))


def dice(a: Column, b: Column) -> Column:
    """Of bigram multisets of the normal forms; 1 if these are equal, 0 if one is shorter than two."""
    count = lambda bag, g: F.size(F.filter(bag, lambda v: v == g))
    both = lambda p, q: F.aggregate(F.array_distinct(p), F.lit(0), lambda n, g: n + F.least(count(p, g), count(q, g)))
    common = lambda x, y: let(_bigrams(x), lambda p: let(_bigrams(y), lambda q: both(p, q)))
    value = lambda x, y: F.when(x == y, F.lit(1.0)).when((F.length(x) < 2) | (F.length(y) < 2), F.lit(0.0)).otherwise(2.0 * common(x, y) / (F.length(x) + F.length(y) - 2))
    return let(norm(a), lambda x: let(norm(b), lambda y: value(x, y)))


def edit_distance(a: Column, b: Column, most: int = 2) -> Column:
    """Levenshtein distance, ``most`` + 1 where it is larger."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, F.lit(most + 1)).otherwise(d)


def text_quality(c: Column, head: int | None = None) -> Column:
    """Share of ordinary characters, in the first ``head`` ones where that is given; 0 for an empty text."""
    whole = F.coalesce(c, F.lit(""))
    part = whole if head is None else F.substring(whole, 1, head)
    normal = F.regexp_count(part, F.lit(r"[A-Za-zÀ-ÿ0-9\s.,;:!?()\-/%]"))
    return F.when(F.length(part) == 0, F.lit(0.0)).otherwise(normal / F.length(part))


def fnv1a(c: Column) -> Column:
    """FNV-1a with 32 bits over the code points of the text."""
    step = lambda h, x: F.pmod(F.pmod(h.bitwiseXOR(F.ascii(x).cast("long")), F.lit(1 << 32)) * F.lit(16777619), F.lit(1 << 32))
    return F.aggregate(F.split(c, ""), F.lit(2166136261).cast("long"), lambda h, x: F.when(x == "", h).otherwise(step(h, x)))


def guess_field(c: Column, *labels: str) -> Column:
    """The value after the first of ``labels`` that stands before a colon; null if none does."""
    found = [F.nullif(F.trim(F.regexp_extract(c, rf"(?im)(?:^|\n)\s*{label}\s*[:\-–]\s*([^\n]{{2,120}})", 1)), F.lit("")) for label in labels]
    return F.coalesce(*found)


def page_of(offset: Column, breaks: Column) -> Column:
    """Page of an offset: one more than the page breaks up to it."""
    return F.size(F.filter(breaks, lambda b: b <= offset)) + 1
