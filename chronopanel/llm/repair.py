"""Repair of scanned pages: words broken across lines, misread glyphs, headers, footers and page numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronopanel.llm.pages import skeletons
from chronopanel.sources.tables import cut

#: Fixed value: a word with the glyphs that scanning puts in it.
TOKEN = r"[\p{L}\p{M}0-9€¢|]+"
#: Marks that break a word at the end of a line, after a letter.
BROKEN = r"[\p{L}\p{M}0-9€¢|][-‐¬]$"
#: A form is misread if it is this much rarer than the most frequent form of its skeleton, and this much rarer on pages
#: that weren't scanned than its count would make one expect.
RARE, UNSEEN = 0.1, 0.15
#: A form that is a word itself is misread if another word of its skeleton is so many times more usual between its
#: neighbours. Odds as high as that need as many occurrences, whatever the size of the corpus.
CONTEXT = 50.0


def scanned(method: Column, confidence: Column) -> Column:
    return (F.coalesce(method, F.lit("")) == "ocr") | (method.isNull() & confidence.isNotNull())


def _tokens(line: Column) -> Column:
    """Words of a line in lower case. The bars of a table aren't glyphs of words."""
    return F.filter(F.regexp_extract_all(F.lower(line), F.lit(TOKEN), F.lit(0)), lambda t: t.rlike(r"[\p{L}]"))


def content(lines: DataFrame, furniture: DataFrame, kinds: DataFrame) -> DataFrame:
    """The text lines of scanned prose, in order: page_id, file_id, page_no, line_no, line, broken, before, after.

    broken: the last word goes on in the next line, which is next_page, next_line (null at the end of the text) and may be
    on the next page of the file. before, after: the first and last words that belong to a word broken across lines.
    """
    out = furniture.select(F.col("page_id").alias("_p"), F.col("line_no").alias("_l")).distinct()
    prose = kinds.where("kind = 'prose'").select(F.col("page_id").alias("_k"))
    mine = lines.where(scanned(F.col("method"), F.col("ocr_confidence"))).select("page_id", "file_id", "page_no", "line_no", "line")
    mine = mine.join(prose, F.col("page_id") == F.col("_k"), "left_semi").join(out, (F.col("page_id") == F.col("_p")) & (F.col("line_no") == F.col("_l")), "left_anti")
    w = W.partitionBy("page_id").orderBy("line_no")
    mine = mine.select("*", F.col("line").rlike(BROKEN).alias("broken"), _tokens(F.col("line")).alias("tokens"))
    seen = mine.select(
        "*", F.lead("line_no").over(w).alias("n_line"), F.lead("tokens").over(w).alias("n_tokens"), F.lag("broken").over(w).alias("p_broken"), F.lag("line_no").over(w).alias("p_line"),
    )
    seen = cut(seen)
    # The last line of a page goes on in the first one of the next page of the file.
    first = seen.where("p_line is null and file_id is not null").groupBy(F.col("file_id").alias("f_file"), (F.col("page_no") - 1).alias("f_no")).agg(F.min_by(F.struct("page_id", "line_no", "tokens"), "page_id").alias("f"))
    last = seen.where("n_line is null and file_id is not null").groupBy(F.col("file_id").alias("l_file"), (F.col("page_no") + 1).alias("l_no")).agg(F.max("broken").alias("l_broken"))
    both = seen.join(first, F.col("n_line").isNull() & (F.col("file_id") == F.col("f_file")) & (F.col("page_no") == F.col("f_no")), "left")
    both = both.join(last, F.col("p_line").isNull() & (F.col("file_id") == F.col("l_file")) & (F.col("page_no") == F.col("l_no")), "left")
    return both.select(
        "page_id", "file_id", "page_no", "line_no", "line", "tokens", "broken",
        F.when(F.col("n_line").isNotNull(), F.col("page_id")).otherwise(F.col("f.page_id")).alias("next_page"), F.coalesce("n_line", "f.line_no").alias("next_line"),
        F.get(F.coalesce("n_tokens", "f.tokens"), F.lit(0)).alias("next_word"), F.coalesce("p_broken", "l_broken", F.lit(False)).alias("goes_on"),
    )


def words(text: DataFrame) -> DataFrame:
    """page_id, line_no, token, part, next_page, next_line, rest of each word of content().

    A word broken across lines comes once, put together, with part and rest: what stands in its line and in the next.
    """
    n = F.size("tokens")
    start = F.when(F.col("goes_on"), 2).otherwise(1)
    whole = F.slice("tokens", start, F.greatest(n - start + 1 - F.col("broken").cast("int"), F.lit(0)))
    single = F.transform(whole, lambda t: F.struct(t.alias("token"), F.lit(None).cast("string").alias("part"), F.lit(None).cast("string").alias("rest")))
    left = F.element_at("tokens", -1)
    split = F.when(F.col("broken") & (n > 0), F.array(F.struct(F.concat(left, F.coalesce("next_word", F.lit(""))).alias("token"), left.alias("part"), F.coalesce("next_word", F.lit("")).alias("rest"))))
    each = text.select("page_id", "line_no", "next_page", "next_line", F.explode(F.concat(single, F.coalesce(split, F.array().cast("array<struct<token:string,part:string,rest:string>>")))).alias("w"))
    return each.select("page_id", "line_no", "w.token", "w.part", "next_page", "next_line", "w.rest")


def vocabulary(lines: DataFrame, kinds: DataFrame, scanned_words: DataFrame) -> DataFrame:
    """token, n, clean: how often each form occurs, and how often of that on pages that weren't scanned; without junk."""
    plain = kinds.where("kind <> 'junk'").select(F.col("page_id").alias("_k"))
    other = lines.where(~scanned(F.col("method"), F.col("ocr_confidence"))).join(plain, F.col("page_id") == F.col("_k"), "left_semi")
    tokens = other.select(F.explode(_tokens(F.col("line"))).alias("token"), F.lit(1).alias("clean")).unionByName(scanned_words.select("token", F.lit(0).alias("clean")))
    return tokens.where(F.length("token") > 1).groupBy("token").agg(F.count("*").alias("n"), F.sum("clean").alias("clean"))


def corrections(vocab: DataFrame) -> DataFrame:
    """token, best: the forms that are misread, and what they stand for.

    Forms of one glyph skeleton are alternatives, with and without merging glyph pairs; the most frequent one made of
    letters alone is right. Others are misread if they are rare beside it and not at home on clean pages. A form with a
    digit or sign inside the letters that has no right form is misread, too, with null best.
    """
    t = F.col("token")
    sign = t.rlike(r"[0-9€¢|]")
    keyed = vocab.select("token", "n", "clean", sign.alias("sign"), F.explode(skeletons(t)).alias("key"))
    best = keyed.where("not sign").groupBy("key").agg(F.max(F.struct("n", "token", "clean")).alias("b")).select(F.col("key").alias("_key"), F.col("b.token").alias("best"), F.col("b.n").alias("bn"), F.col("b.clean").alias("bc"))
    pairs = keyed.join(best, keyed["key"] == best["_key"]).where("token <> best")
    letters = F.length(F.regexp_replace("token", r"[^\p{L}]", ""))
    rare = (F.col("n") <= RARE * F.col("bn")) & ((F.col("bc") == 0) | (F.col("clean") <= UNSEEN * F.col("n")))
    wrong = pairs.where((F.col("sign") & (letters >= 2)) | (~F.col("sign") & rare))
    known = wrong.groupBy("token").agg(F.max_by("best", F.struct("bn", "best")).alias("best"))
    inside = t.rlike(r"[\p{L}][€¢|]|[€¢][\p{L}]|[\p{L}]{2}[0156][\p{L}]|[\p{L}][0156][\p{L}]{2}") & (F.length(F.regexp_replace("token", r"[^\p{L}]", "")) >= 4)
    alone = vocab.where(inside).select("token").join(known.select("token"), "token", "left_anti").select("token", F.lit(None).cast("string").alias("best"))
    return known.unionByName(alone)


def _with_numbers(line: Column) -> Column:
    """Words of a line in lower case, and # for each number."""
    return F.transform(F.regexp_extract_all(F.lower(line), F.lit(TOKEN), F.lit(0)), lambda t: F.when(t.rlike(r"\p{L}"), t).otherwise("#"))


def _neighbours(tokens: str) -> Column:
    """The words of a line with the ones before and after them."""
    t = F.col(tokens)
    return F.transform(t, lambda x, i: F.struct(x.alias("token"), F.get(t, i - 1).alias("before"), F.get(t, i + 1).alias("after")))


def misplaced(lines: DataFrame, kinds: DataFrame, text: DataFrame, vocab: DataFrame) -> DataFrame:
    """page_id, line_no, token, best: words of text read as another word, by what stands before and after them in the line.

    Words of one glyph skeleton that occur on clean pages are weighed against each other; their neighbours are counted over
    all pages but junk. A word broken across lines is left out.
    """
    often = vocab.where((F.col("clean") > 0) & ~F.col("token").rlike("[0-9€¢|]")).select("token", F.explode(skeletons(F.col("token"))).alias("key"))
    pairs = often.join(often.select(F.col("token").alias("best"), "key"), "key").where("token <> best").select("token", "best").distinct()
    pairs = cut(pairs)
    some = pairs.select("token").distinct()
    plain = kinds.where("kind <> 'junk'").select(F.col("page_id").alias("_k"))
    other = lines.join(plain, F.col("page_id") == F.col("_k"), "left_semi").select(_with_numbers(F.col("line")).alias("tokens"))
    near = other.select(F.explode(_neighbours("tokens")).alias("w")).select("w.*").join(some, "token", "left_semi")
    sides = near.select("token", F.explode(F.array(F.struct(F.lit("b").alias("side"), F.col("before").alias("word")), F.struct(F.lit("a").alias("side"), F.col("after").alias("word")))).alias("s"))
    counts = cut(sides.where("s.word is not null").groupBy("token", "s.side", "s.word").agg(F.count("*").alias("c")))
    n = F.size("tokens")
    start = F.when(F.col("goes_on"), 2).otherwise(1)
    whole = text.withColumn("tokens", _with_numbers(F.col("line"))).select("page_id", "line_no", F.slice("tokens", start, F.greatest(n - start + 1 - F.col("broken").cast("int"), F.lit(0))).alias("tokens"))
    mine = whole.select("page_id", "line_no", F.explode(_neighbours("tokens")).alias("w")).select("page_id", "line_no", "w.*").join(pairs, "token")
    for side, word in (("b", "before"), ("a", "after")):
        c = counts.where(F.col("side") == side).select(F.col("token").alias("_t"), F.col("word").alias("_w"), F.col("c").alias("_c"))
        for form in ("token", "best"):
            mine = mine.join(c, (F.col(form) == F.col("_t")) & (F.col(word) == F.col("_w")), "left").withColumn(f"{form}_{side}", F.coalesce("_c", F.lit(0))).drop("_t", "_w", "_c")
    # The occurrence itself counts once on either side.
    gain = lambda x: (F.col(f"best_{x}") + 1) / F.greatest(F.col(f"token_{x}"), F.lit(1))
    odds = F.when(F.col("before").isNull(), F.lit(1.0)).otherwise(gain("b")) * F.when(F.col("after").isNull(), F.lit(1.0)).otherwise(gain("a"))
    return mine.where(odds >= CONTEXT).groupBy("page_id", "line_no", "token").agg(F.max_by("best", odds).alias("best"))


def damaged_lines(lines: DataFrame, furniture: DataFrame, kinds: DataFrame) -> DataFrame:
    """page_id, line_no, kind of each scanned line that needs repair: running, page_number, hyphen or misread.

    Lists, tables and junk can have the first two only; a running line or page number has no other kind.
    """
    pages = lines.where(scanned(F.col("method"), F.col("ocr_confidence"))).select(F.col("page_id").alias("_s")).distinct()
    first = furniture.join(pages, F.col("page_id") == F.col("_s"), "left_semi").select("page_id", "line_no", "kind")
    text = cut(content(lines, furniture, kinds))
    each = cut(words(text))
    vocab = cut(vocabulary(lines, kinds, each))
    hit = each.join(corrections(vocab), "token")
    whole = hit.where("part is null").select("page_id", "line_no").unionByName(misplaced(lines, kinds, text, vocab).select("page_id", "line_no"))
    split = hit.where("part is not null")
    left = split.where("best is null or not startswith(best, part)").select("page_id", "line_no")
    right = split.where("(best is null or not endswith(best, rest)) and rest <> '' and next_page is not null").select(F.col("next_page").alias("page_id"), F.col("next_line").alias("line_no"))
    misread = whole.unionByName(left).unionByName(right).distinct().select("page_id", "line_no", F.lit("misread").alias("kind"))
    return first.unionByName(text.where("broken").select("page_id", "line_no", F.lit("hyphen").alias("kind"))).unionByName(misread)


def compounds(lines: DataFrame, kinds: DataFrame) -> DataFrame:
    """part, rest, n: how often two words stand side by side with a hyphen between them inside a line, without junk."""
    plain = kinds.where("kind <> 'junk'").select(F.col("page_id").alias("_k"))
    chains = F.regexp_extract_all(F.lower("line"), F.lit(rf"{TOKEN}(?:[-‐]{TOKEN})+"), F.lit(0))
    some = lines.where(F.col("line").rlike(r"\p{L}[-‐]\p{L}")).join(plain, F.col("page_id") == F.col("_k"), "left_semi")
    links = some.select(F.explode(chains).alias("c")).select(F.split("c", "[-‐]").alias("p")).where("size(p) > 1")
    pairs = links.select(F.explode(F.arrays_zip(F.slice("p", 1, F.size("p") - 1).alias("part"), F.slice("p", 2, F.size("p") - 1).alias("rest"))).alias("x"))
    return pairs.groupBy(F.col("x.part").alias("part"), F.col("x.rest").alias("rest")).agg(F.count("*").alias("n"))


def paragraphs(lines: DataFrame, furniture: DataFrame, kinds: DataFrame) -> DataFrame:
    """page_id, paragraph, text: the continuous text of each scanned page, repaired.

    Misread words are replaced where their right form is known, words broken across lines are put together, with the hyphen
    if the corpus writes the two parts with one at least as often as without; a new paragraph starts after a blank line, at
    an indented line or at a numbered entry. Headers, footers and page numbers are left out. A word broken at the end of the
    page keeps its mark. Of lists, tables and junk every line is a paragraph, as it is.
    """
    text = cut(content(lines, furniture, kinds))
    each = cut(words(text))
    vocab = cut(vocabulary(lines, kinds, each))
    wrong = cut(corrections(vocab).where("best is not null"))
    found = each.where("part is null").join(wrong, "token").select("page_id", "line_no", "token", "best").unionByName(misplaced(lines, kinds, text, vocab))
    fixes = found.groupBy(F.col("page_id").alias("_p"), F.col("line_no").alias("_l")).agg(F.collect_set(F.struct("token", "best")).alias("fixes"))
    split = each.where("part is not null and next_page = page_id").select("page_id", "line_no", "token", "part", "rest")
    split = split.join(vocab.select("token", F.col("n").alias("_whole")), "token", "left").join(wrong, "token", "left").join(compounds(lines, kinds).withColumnRenamed("n", "_apart"), ["part", "rest"], "left")
    # Every form broken in a scanned page counts as written whole once by itself.
    apart = F.coalesce(F.col("_apart"), F.lit(0)) >= F.greatest(F.coalesce("_whole", F.lit(0)) - 1, F.lit(1))
    word = F.when(F.col("best").isNull() & apart, F.concat_ws("-", "part", "rest")).otherwise(F.coalesce("best", "token"))
    joined = split.groupBy(F.col("page_id").alias("_jp"), F.col("line_no").alias("_jl")).agg(F.min(F.struct(word.alias("word"), "part", "rest")).alias("j"))
    rows = text.join(fixes, (F.col("page_id") == F.col("_p")) & (F.col("line_no") == F.col("_l")), "left").join(joined, (F.col("page_id") == F.col("_jp")) & (F.col("line_no") == F.col("_jl")), "left")
    edge = "[\\p{L}\\p{M}0-9€¢|]"

    def swap(acc: Column, f: Column) -> Column:
        token, best = F.regexp_replace(f["token"], r"\|", r"\\\\|"), f["best"]
        at = F.concat(F.lit(f"(?<!{edge})"), token, F.lit(f"(?!{edge})"))
        upper = F.concat(F.upper(F.substring(best, 1, 1)), F.substr(best, F.lit(2)))
        capital = F.concat(F.lit(f"(?<!{edge})"), F.upper(F.substring(f["token"], 1, 1)), F.regexp_replace(F.substr(f["token"], F.lit(2)), r"\|", r"\\\\|"), F.lit(f"(?!{edge})"))
        return F.regexp_replace(F.regexp_replace(acc, at, best), capital, upper)

    fixed = F.aggregate(F.coalesce("fixes", F.array().cast("array<struct<token:string,best:string>>")), F.col("line"), swap)
    w = W.partitionBy("page_id").orderBy("line_no")
    opens = (F.col("line_no") - F.lag("line_no").over(w) > 1) | F.col("line").rlike(r"^\s{2,}\S|^\s*(?:\(?\d{1,3}[.)]|\(\p{L}\))\s") | F.lag("line_no").over(w).isNull()
    taken = F.lag(F.col("j").isNotNull()).over(w)
    body = F.when(F.coalesce(taken, F.lit(False)), F.regexp_replace(F.trim(fixed), "^" + TOKEN, "")).otherwise(F.trim(fixed))
    head = F.regexp_replace(body, TOKEN + "[-‐¬]$", "")
    capital = F.regexp_extract("line", r"(\p{Lu})[^\s]*$", 1) != ""
    word = F.col("j.word")
    word = F.when(capital, F.concat(F.upper(F.substring(word, 1, 1)), F.substr(word, F.lit(2)))).otherwise(word)
    piece = F.when(F.col("j").isNotNull(), F.concat(head, word)).otherwise(body)
    parts = rows.select("page_id", "line_no", (opens & ~F.coalesce(taken, F.lit(False))).alias("opens"), piece.alias("piece"), F.coalesce(taken, F.lit(False)).alias("glued"))
    parts = parts.withColumn("paragraph", F.sum(F.col("opens").cast("int")).over(w).cast("int"))
    lined = parts.groupBy("page_id", "paragraph").agg(F.array_sort(F.collect_list(F.struct("line_no", "glued", "piece"))).alias("l"))
    text_of = F.aggregate("l", F.lit(""), lambda acc, x: F.when((acc == "") | x["glued"], F.concat(acc, x["piece"])).otherwise(F.concat(acc, F.lit(" "), x["piece"])))
    out = furniture.select(F.col("page_id").alias("_p"), F.col("line_no").alias("_l")).distinct()
    other = kinds.where("kind <> 'prose'").select(F.col("page_id").alias("_k"))
    plain = lines.where(scanned(F.col("method"), F.col("ocr_confidence"))).select("page_id", "line_no", "line").join(other, F.col("page_id") == F.col("_k"), "left_semi")
    plain = plain.join(out, (F.col("page_id") == F.col("_p")) & (F.col("line_no") == F.col("_l")), "left_anti").select("page_id", F.row_number().over(w).cast("int").alias("paragraph"), F.trim("line").alias("text"))
    return lined.select("page_id", "paragraph", F.trim(F.regexp_replace(text_of, r"\s+", " ")).alias("text")).unionByName(plain)
