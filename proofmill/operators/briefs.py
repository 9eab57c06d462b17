"""Requirements from briefs: cell tables (brief_id, sheet, row, col, value) to keywords, sections, fields, links and a state.

Rows and columns count from 1. Briefs are small; every step is a join or aggregate over all briefs' cells at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Header and field patterns (fixed values)
KEYWORD_HEADER = r"(?i)keywords?|main\s*kw"
QUANTITY_HEADER = r"(?i)(qty|quantity|count|#)"
SECTION_HEADER = r"(?i)section|heading|structure|outline|content"
WORDS_HEADER = r"(?i)word\s*count|words?|length"
FIELDS = {
    "brand": r"brand|client|website|site\s*name",
    "locale": r"locale|language|region",
    "market": r"market|country|geo|target",
    "word_count": r"(?:total\s*)?(?:word\s*count|words?|length|target\s*length)",
    "task": r"task|topic|article\s*type|content\s*type|type",
}
COLUMN_HINT = r"(?i)keyword|\bkw\b|\bmain\b|support|\blsi\b|secondary"
LINK_ANCHOR, LINK_URL = r"(?i)^link\s*\d*\s*[—\-–]?\s*anchor", r"(?i)^link\s*\d*\s*[—\-–]?\s*url"
DULL_SHEETS = ["sheet1", "data", "info", "meta", "keywords"]
KEYWORD_VOTES = {
    "game_review": r"\bslot\b|\bslots\b|\brtp\b|\bfree\s*spin|\bpragmatic|\bnetent\b|\bdemo\b|\bmax\s*win",
    "sports_market": r"\bbet\b|\bbetting\b|\bodds\b|\bprediction|\bboxing\b|\bfootball\b|\bbasketball\b|\btennis\b|\bcricket\b|\bracing\b|\bsports?\b|\bmoneyline\b",
    "bonus_page": r"\bbonus\b|\bbonuses\b|\bpromo\b|\bpromotion|\bwelcome\b|\bcashback\b|\breload\b|\bloyalty\b|\bvip\b|\breward",
    "app_review": r"\bapp\b|\bapk\b|\bdownload\b|\bmobile\b|\bandroid\b|\bios\b",
    "payments": r"\bpayment\b|\bdeposit\b|\bwithdraw\b|\bbanking\b|\bpayout\b",
}
#: Confidence under which a field is asked about.
LEAST = {"keywords": 0.7, "sections": 0.6, "article_type": 0.6, "word_count": 0.5}


def group_name(header: Column) -> Column:
    return F.when(header.rlike(r"(?i)\bmain\b|primary|focus"), "main").when(header.rlike(r"(?i)support|secondary|additional"), "support").when(header.rlike(r"(?i)\blsi\b|latent|semantic|related"), "lsi").otherwise("main")


def filled(cells: DataFrame) -> DataFrame:
    return cells.withColumn("value", F.trim("value")).where("value <> ''")


def under_headers(cells: DataFrame, header: str, number: str, depth: int) -> DataFrame:
    """(brief_id, sheet, head, hrow, hcol, ncol, row, value, number): column entries under each header cell.

    ncol is the nearest column within four to the right whose header matches number, if any. Entries end at the first row
    that is empty from the header's column to four columns right of it.
    """
    c = filled(cells)
    key = ["brief_id", "sheet"]
    heads = c.where(F.col("value").rlike(header) & (F.col("row") <= 100)).select(*key, F.col("value").alias("head"), F.col("row").alias("hrow"), F.col("col").alias("hcol"))
    right = c.where(F.col("value").rlike(number)).select(*key, F.col("row").alias("hrow"), F.col("col").alias("c2"))
    near = heads.join(right, [*key, "hrow"], "left").withColumn("c2", F.when(F.col("c2").between(F.col("hcol") + 1, F.col("hcol") + 4), F.col("c2")))
    heads = near.groupBy(*key, "head", "hrow", "hcol").agg(F.min("c2").alias("ncol"))
    below = c.select(*key, "row", "col", "value")
    used = heads.join(below, key).where("row > hrow AND row < hrow + " + str(depth) + " AND col BETWEEN hcol AND hcol + 4")
    rows = used.groupBy(*key, "head", "hrow", "hcol", "ncol", "row").agg(F.max(F.when(F.col("col") == F.col("hcol"), F.col("value"))).alias("value"), F.max(F.when(F.col("col") == F.col("ncol"), F.col("value"))).alias("number"))
    w = Window.partitionBy(*key, "hrow", "hcol").orderBy("row")
    # without a gap, the nth row stands n rows under the header
    return rows.withColumn("n", F.row_number().over(w)).where("row = hrow + n AND value IS NOT NULL").drop("n")


def keywords(cells: DataFrame) -> DataFrame:
    """(brief_id, keyword, low, high, grp, confidence): tables first, else columns with a hint, else lists in a cell."""
    real = lambda c: ~T.is_metadata_label(c)
    found = under_headers(cells, KEYWORD_HEADER, QUANTITY_HEADER, 100).where(real(F.col("value"))).withColumn("keyword", T.clean_keyword(F.col("value"))).where(real(F.col("keyword")))
    q = F.when(F.col("ncol").isNotNull(), T.quantity_range(F.col("number")))
    tables = found.select("brief_id", "keyword", q["low"].alias("low"), q["high"].alias("high"), group_name(F.col("head")).alias("grp"), F.when(F.col("ncol").isNotNull(), 0.95).otherwise(0.8).alias("confidence"), "hrow", "hcol", "row")
    c = filled(cells)
    none = F.lit(None).cast("int")
    hints = c.where((F.col("row") == 1) & F.col("value").rlike(COLUMN_HINT)).select("brief_id", "sheet", F.col("value").alias("head"), "col")
    listed = hints.join(c.where("row BETWEEN 2 AND 99"), ["brief_id", "sheet", "col"]).where(real(F.col("value"))).withColumn("keyword", T.clean_keyword(F.col("value"))).where(real(F.col("keyword")))
    columns = listed.select("brief_id", "keyword", none.alias("low"), none.alias("high"), group_name(F.col("head")).alias("grp"), F.lit(0.75).alias("confidence"), F.lit(1).alias("hrow"), F.col("col").alias("hcol"), "row").join(tables.select("brief_id").distinct(), "brief_id", "left_anti")
    inline = r"(?i)^(main\s*)?keywords?\s*[:=]\s*(.+)"
    parts = c.where(F.col("value").rlike(inline)).select("brief_id", "row", "col", F.explode(F.split(F.regexp_extract("value", inline, 2), "[,;/]")).alias("part")).withColumn("part", F.trim("part")).where(real(F.col("part")))
    tail = r"^(.+?)\s*(?:[(\-]\s*(\d+)\s*[x×]?\s*\)?|[x×]\s*(\d+))$"
    n = F.coalesce(F.regexp_extract("part", tail, 2).try_cast("int"), F.regexp_extract("part", tail, 3).try_cast("int"))
    word = T.clean_keyword(F.when(F.col("part").rlike(tail), F.regexp_extract("part", tail, 1)).otherwise(F.col("part")))
    lists = parts.select("brief_id", word.alias("keyword"), n.alias("low"), n.alias("high"), F.lit("main").alias("grp"), F.lit(0.65).alias("confidence"), F.col("row").alias("hrow"), F.col("col").alias("hcol"), "row").where(real(F.col("keyword")))
    other = tables.select("brief_id").union(columns.select("brief_id")).distinct()
    return dedupe(tables.unionByName(columns).unionByName(lists.join(other, "brief_id", "left_anti")))


def dedupe(rows: DataFrame) -> DataFrame:
    """Of keywords that are equal without case in a group, the surest, then one with a quantity, then the first."""
    w = Window.partitionBy("brief_id", F.lower("keyword"), "grp").orderBy(F.desc("confidence"), F.col("low").isNull() & F.col("high").isNull(), "hrow", "hcol", "row")
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").select("brief_id", "keyword", "low", "high", "grp", "confidence")


def sections(cells: DataFrame) -> DataFrame:
    """(brief_id, heading, word_count, confidence, ord) of the first section table of each brief."""
    rows = under_headers(cells, SECTION_HEADER, WORDS_HEADER, 50)
    first = Window.partitionBy("brief_id").orderBy("sheet", "hrow", "hcol")
    rows = rows.withColumn("r", F.dense_rank().over(first)).where("r = 1")
    number = F.greatest(F.regexp_extract("number", r"(\d+)", 1).try_cast("int"), F.lit(1))
    return rows.select("brief_id", F.col("value").alias("heading"), F.when(F.col("number").isNotNull(), number).alias("word_count"), F.when(F.col("ncol").isNotNull(), 0.95).otherwise(0.75).alias("confidence"), F.col("row").alias("ord"))


def fields(cells: DataFrame) -> DataFrame:
    """(brief_id, field, value, confidence): from the cell to the right of a label, or after a colon; the first counts."""
    c = filled(cells).where("row <= 30 AND col <= 10")
    right = c.select("brief_id", "sheet", "row", (F.col("col") - 1).alias("col"), F.col("value").alias("next"))
    both = c.join(right, ["brief_id", "sheet", "row", "col"], "left")
    parts = []
    for name, p in FIELDS.items():
        sure = (0.9, 0.8) if name == "word_count" else (0.85, 0.75)
        inline = F.regexp_extract("value", rf"(?i)^(?:{p})\s*[:=]\s*(.+)", 1)
        parts.append(both.where(F.col("value").rlike("(?i)" + p) & F.col("next").isNotNull()).select("brief_id", F.lit(name).alias("field"), F.col("next").alias("v"), F.lit(sure[0]).alias("confidence"), "sheet", "row", "col", F.lit(0).alias("kind")))
        parts.append(both.withColumn("v", inline).where("v <> ''").select("brief_id", F.lit(name).alias("field"), "v", F.lit(sure[1]).alias("confidence"), "sheet", "row", "col", F.lit(1).alias("kind")))
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    w = Window.partitionBy("brief_id", "field").orderBy("sheet", "row", "col", "kind")
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").select("brief_id", "field", F.trim("v").alias("value"), "confidence")


def tasks(cells: DataFrame) -> DataFrame:
    """(brief_id, task): right of a task label, or above that cell if it is empty; else the names of several telling sheets (of workbooks)."""
    c = filled(cells).where("row <= 20")
    label = c.where(F.col("value").rlike("(?i)" + FIELDS["task"]) & (F.col("col") <= 10)).select("brief_id", "sheet", "row", (F.col("col") + 1).alias("col"))
    here = filled(cells).select("brief_id", "sheet", "row", "col", F.col("value").alias("own"))
    above = here.select("brief_id", "sheet", (F.col("row") + 1).alias("row"), "col", F.col("own").alias("up"))
    named = label.join(here, ["brief_id", "sheet", "row", "col"], "left").join(above, ["brief_id", "sheet", "row", "col"], "left")
    named = named.select("brief_id", F.coalesce("own", "up").alias("task")).where("task IS NOT NULL").distinct()
    sheets = cells.select("brief_id", "sheet").distinct().where(~F.lower("sheet").isin(DULL_SHEETS) & ~F.col("sheet").rlike(r"^(table \d+|text)$"))
    many = sheets.withColumn("n", F.count("*").over(Window.partitionBy("brief_id"))).where("n > 1").select("brief_id", F.col("sheet").alias("task"))
    return named.union(many.join(named.select("brief_id").distinct(), "brief_id", "left_anti"))


def links(cells: DataFrame) -> DataFrame:
    """(brief_id, anchor, url, link_type, confidence): a link's anchor, and its URL in the row below."""
    c = filled(cells).where("row <= 100")
    shift = lambda r, k, name, p=None: (c if p is None else c.where(F.col("value").rlike(p))).select("brief_id", "sheet", (F.col("row") - r).alias("row"), (F.col("col") - k).alias("col"), F.col("value").alias(name))
    on = ["brief_id", "sheet", "row", "col"]
    rows = c.where(F.col("value").rlike(LINK_ANCHOR)).join(shift(0, 1, "anchor"), on).join(shift(1, 0, "label", LINK_URL), on, "left").join(shift(1, 1, "below"), on, "left")
    url = F.when(F.col("label").isNotNull(), F.col("below"))
    inside = F.startswith(url, F.lit("/")) | (~F.startswith(url, F.lit("http")) & F.contains(url, F.lit("/")))
    return rows.select("brief_id", "anchor", F.coalesce(url, F.lit("")).alias("url"), F.when(inside, "internal").otherwise("external").alias("link_type"), F.when(url.isNotNull(), 0.85).otherwise(0.6).alias("confidence"))


def keyword_vote(found: DataFrame) -> DataFrame:
    """(brief_id, type, confidence) from the keywords themselves: the kind with most hits, general at under two or near ties."""
    texts = found.groupBy("brief_id").agg(F.array_join(F.sort_array(F.collect_list(F.lower("keyword"))), " ").alias("t"))
    votes = F.array_sort(F.array(*(F.struct((-F.regexp_count("t", F.lit(p))).alias("n"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, (k, p) in enumerate(KEYWORD_VOTES.items()))))
    rows = texts.withColumn("v", votes).withColumn("top", -F.get("v", 0)["n"])
    ties = F.size(F.filter("v", lambda x: (-x["n"] >= F.col("top") * 0.8) & (x["n"] < 0)))
    clear = (F.col("top") >= 2) & (ties == 1)
    sure = F.when(F.col("top") >= 10, 0.85).when(F.col("top") >= 5, 0.75).otherwise(0.65)
    return rows.select("brief_id", F.when(clear, F.get("v", 0)["k"]).otherwise("general").alias("type"), F.when(F.col("top") < 2, 0.4).when(ties > 1, 0.45).otherwise(sure).alias("confidence"))


def parse(cells: DataFrame, task: str | None = None) -> DataFrame:
    """One row per brief: its state, fields and confidences. A brief with several tasks needs one of them named."""
    ids = cells.select("brief_id").distinct()
    f = fields(cells).groupBy("brief_id").pivot("field", list(FIELDS)).agg(F.first("value").alias("v"), F.first("confidence").alias("c"))
    k, s, t = keywords(cells), sections(cells), tasks(cells)
    kn = k.groupBy("brief_id").agg(F.count("*").alias("keywords"), F.max("confidence").alias("keywords_confidence"))
    sn = s.groupBy("brief_id").agg(F.count("*").alias("sections"), F.max("confidence").alias("sections_confidence"))
    tn = t.groupBy("brief_id").agg(F.sort_array(F.collect_set("task")).alias("tasks"))
    vote = keyword_vote(k).select("brief_id", F.col("type").alias("voted"), F.col("confidence").alias("voted_confidence"))
    rows = ids
    for part in (f, kn, sn, tn, vote):
        rows = rows.join(part, "brief_id", "left")
    rows = rows.withColumn("tasks", F.coalesce("tasks", F.array().cast("array<string>")))
    rows = rows.withColumn("task_name", F.lit(task).cast("string") if task else F.coalesce(F.get("tasks", 0), "task_v")).withColumn("mapped", T.task_type(F.col("task_name")))
    weak = (F.col("mapped.confidence") < LEAST["article_type"]) & (F.coalesce("voted_confidence", F.lit(0.0)) > F.col("mapped.confidence"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rows = rows.select(
        "brief_id", "tasks", "task_name", F.when(weak, F.col("voted")).otherwise(F.col("mapped.type")).alias("article_type"), F.when(weak, F.col("voted_confidence")).otherwise(F.col("mapped.confidence")).alias("article_type_confidence"),
        F.coalesce(F.regexp_extract("word_count_v", r"(\d+)", 1).try_cast("int"), F.lit(0)).alias("target_word_count"), zero("word_count_c").alias("word_count_confidence"), F.col("locale_v").alias("locale"), F.col("market_v").alias("market"),
        F.col("brand_v").alias("brand_name"), F.coalesce("keywords", F.lit(0)).alias("keywords"), zero("keywords_confidence").alias("keywords_confidence"), F.coalesce("sections", F.lit(0)).alias("sections"), zero("sections_confidence").alias("sections_confidence"),
    )
    asks = F.size(questions()) > 0
    state = F.when((F.size("tasks") > 1) & F.lit(task is None), "NEEDS_TASK_SELECTION").when(asks, "NEEDS_CLARIFICATION").otherwise("READY")
    return rows.withColumn("state", state)


def questions() -> Column:
    """The fields of a brief that are too unsure, as an array of structs."""
    weak = (
        ("keywords", F.col("keywords_confidence") < LEAST["keywords"], F.col("keywords_confidence")), ("sections", F.col("sections_confidence") < LEAST["sections"], F.col("sections_confidence")),
        ("article_type", F.col("article_type_confidence") < LEAST["article_type"], F.col("article_type_confidence")),
        ("target_word_count", (F.col("target_word_count") == 0) & (F.col("word_count_confidence") < LEAST["word_count"]), F.col("word_count_confidence")),
    )
    return F.filter(F.array(*(F.when(c, F.struct(F.lit(n).alias("field"), v.alias("confidence"))) for n, c, v in weak)), lambda x: x.isNotNull())


def clarifications(briefs: DataFrame) -> DataFrame:
    return briefs.select("brief_id", F.explode(questions()).alias("q")).select("brief_id", "q.field", "q.confidence")


def confirm(briefs: DataFrame, answers: DataFrame) -> DataFrame:
    """Briefs with answers (brief_id, field, value) of a person over them; an answered field is certain."""
    a = answers.groupBy("brief_id").pivot("field", ["article_type", "target_word_count", "market", "locale", "brand_name"]).agg(F.first("value"))
    a = a.select("brief_id", *(F.col(c).alias(f"a_{c}") for c in a.columns[1:]))
    rows = briefs.join(a, "brief_id", "left")
    sure = lambda c, field: F.when(F.col(f"a_{field}").isNotNull(), 1.0).otherwise(F.col(c)).alias(c)
    own = {
        "article_type": F.coalesce("a_article_type", "article_type"), "target_word_count": F.coalesce(F.col("a_target_word_count").try_cast("int"), "target_word_count"), "market": F.coalesce("a_market", "market"),
        "locale": F.coalesce("a_locale", "locale"), "brand_name": F.coalesce("a_brand_name", "brand_name"),
    }
    rows = rows.select(*(own[c].alias(c) if c in own else sure(c, "article_type") if c == "article_type_confidence" else sure(c, "target_word_count") if c == "word_count_confidence" else F.col(c) for c in briefs.columns))
    return rows.withColumn("state", F.when(F.size(questions()) > 0, "NEEDS_CLARIFICATION").otherwise("READY"))
