"""What a SQL text looks like, judged by patterns on the text column.

Patterns avoid look-around and possessive forms, so that RE2 engines read them too.
Quoted literals are blanked before words and numbers are searched.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tableviews.functions.binding import bind

# Tag names, their order, and the words that decide them.
TAGS = ["Aggregation", "Max/Min", "Join", "Ranking", "Comparison", "SimpleProjection"]
LOOKUP_TAG = "SimpleProjection"

TABLE_AFTER_KEYWORD = r"(?i)\b(?:from|join)\s+[`\"\[]?(\w+)"
QUOTED_TEXT = r"'[^']*'|`[^`]*`|\"[^\"]*\""
AGGREGATE_WORD = r"(?i)(^|[^\w.])(sum|avg|count)([^\w]|$)"
EXTREME_WORD = r"(?i)(^|[^\w.])(max|min)([^\w]|$)|\blimit\b.*(^|[^\w.])1([^\w.]|$)"
JOIN_WORD = r"(?i)\bjoin\b"
ORDER_WORD = r"(?i)\border\s+by\b"
JOIN_CONDITION = r"(?i)\b(?:on|using)\b.*?(\bwhere\b|\bgroup\s+by\b|\bhaving\b|\border\s+by\b|\blimit\b|$)"
NUMBER_AFTER_OPERATOR = r"(?i)(<=|>=|<>|!=|=|<|>|\bbetween\b|\bin\b)\s*[+-]?\d+(\.\d+)?([^\w.]|$)"
NUMBER_BEFORE_OPERATOR = r"(?i)(^|[^\w.])\d+(\.\d+)?\s*(<=|>=|<>|!=|=|<|>|\bbetween\b|\bin\b)"

# A text is cut into clauses at these words, once its quoted parts are masked.
CLAUSE_WORD = r"(?i)\b(?:select|from|where|group by|order by|having|limit|union|intersect|except)\b"
LOOKUP_CLAUSES = [["select", "from"], ["select", "from", "where"], ["select", "from", "limit"], ["select", "from", "where", "limit"]]
NO_LOOKUP_WORD = r"(?i)\b(?:join|sum|avg|count)\b|\b(?:min|max)\s*\("

# Masks: a sign for the kind of quote, the number of the quoted part, a closing sign.
MASKED_PART = r"[\u0001-\u0003](\d+)\u0004"
MASKED_TEXT, MASKED_EITHER, MASKED_NAME = "\u0001", "\u0002", "\u0003"
BRACKETED = r"|\[[^\]]*\]"
RANGE_SIGN = "\u0005"


def one_line(sql: Column) -> Column:
    return F.trim(F.regexp_replace(sql, r"\s+", " "))


def sql_tables(sql: Column) -> Column:
    """Distinct words after FROM and JOIN, in text order; case is kept."""
    return F.array_distinct(F.regexp_extract_all(sql, F.lit(TABLE_AFTER_KEYWORD), F.lit(1)))


def masked(sql: Column) -> Column:
    """STRUCT<text, quoted>: the text with a numbered mask in place of every quoted part, and these parts.

    Quotes hide commas, brackets and words from everything that looks at the text afterwards.
    """
    pattern = QUOTED_TEXT + BRACKETED

    def mask(part: Column, number: Column) -> Column:
        kind = (
            F.when(F.startswith(part, F.lit("'")), MASKED_TEXT).when(F.startswith(part, F.lit('"')), MASKED_EITHER).otherwise(MASKED_NAME)
        )
        return F.coalesce(F.concat(kind, number.cast("string"), F.lit("\u0004")), F.lit(""))

    def put_together(pieces: Column, quoted: Column) -> Column:
        text = F.array_join(F.transform(pieces, lambda piece, i: F.concat(piece, F.when(i < F.size(quoted), mask(F.get(quoted, i), i)).otherwise(""))), "")
        return F.struct(text.alias("text"), quoted.alias("quoted"))

    return bind(F.regexp_extract_all(sql, F.lit(pattern), F.lit(0)), lambda quoted: put_together(F.split(sql, pattern, -1), quoted))


def unmasked(text: Column, quoted: Column) -> Column:
    """A piece of a masked text with its quoted parts back in place."""
    def put_back(numbers: Column) -> Column:
        put = lambda piece, i: F.concat(piece, F.coalesce(F.get(quoted, F.get(numbers, i).try_cast("int")), F.lit("")))
        return F.array_join(F.transform(F.split(text, MASKED_PART, -1), put), "")

    numbers = F.regexp_extract_all(text, F.lit(MASKED_PART), F.lit(1))
    return F.when(F.contains(text, F.lit("\u0004")), bind(numbers, put_back)).otherwise(text)


def clauses(text: Column) -> Column:
    """STRUCT<words, parts> of a masked line: the words that begin its clauses, in order and lower case, and what stands between."""
    words = F.transform(F.regexp_extract_all(text, F.lit(CLAUSE_WORD), F.lit(0)), lambda w: F.lower(w))
    return F.struct(words.alias("words"), F.split(text, CLAUSE_WORD, -1).alias("parts"))


def clause(cut: Column, word: str) -> Column:
    """What follows the first ``word`` up to the next clause; empty if there is none."""
    at = F.array_position(cut["words"], F.lit(word)).cast("int")
    return F.when(at > 0, F.trim(F.get(cut["parts"], at))).otherwise("")


def _is_name(item: Column) -> Column:
    """A column: words joined by at most one point, or one quoted part that is no text."""
    words = F.split(item, r"\.", -1)
    plain = (F.size(words) <= 2) & F.forall(words, lambda w: w.rlike(r"^\w+$") & ~w.rlike(r"^\d"))
    return plain | (item.rlike(f"^{MASKED_PART}$") & ~F.startswith(item, F.lit(MASKED_TEXT)))


def _is_value(item: Column) -> Column:
    """A number with digits on both sides of its point, or one quoted part that is no name."""
    number = item.rlike(r"^[+-]?\d+$") | item.rlike(r"^[+-]?\d+\.\d+$")
    return (item.rlike(f"^{MASKED_PART}$") & ~F.startswith(item, F.lit(MASKED_NAME))) | number


def _all_trimmed(items: Column) -> Column:
    return F.transform(items, lambda x: F.trim(x))


def is_lookup(sql: Column) -> Column:
    """One table, plain columns, and at most AND-ed comparisons with literals."""
    return bind(one_line(sql), _line_is_lookup)


def _line_is_lookup(q: Column) -> Column:
    return lookup_parts(q).isNotNull()


def lookup_parts(q: Column) -> Column:
    """STRUCT<preds, names> of a line that is a lookup: its predicates and bare column names; NULL for any other."""
    def listed_names(cut: Column) -> Column:
        return _all_trimmed(F.split(F.regexp_replace(clause(cut, "select"), r"(?i)^distinct\s+", ""), ","))

    def put_together(c: Column, quoted: Column) -> Column:
        fits = c["preds"].isNotNull() & F.forall(c["listed"], lambda item: (item == "*") | _is_name(item))
        names = F.transform(c["listed"], lambda item: bare_name(unmasked(item, quoted)))
        return F.when(fits, F.struct(c["preds"].alias("preds"), names.alias("names")))

    def of_clauses(cut: Column, quoted: Column) -> Column:
        fits = cut["words"].isin(*[F.array(*[F.lit(w) for w in words]) for words in LOOKUP_CLAUSES])
        pieces = F.struct(_masked_predicates(clause(cut, "where"), quoted).alias("preds"), listed_names(cut).alias("listed"))
        return F.when(fits, bind(pieces, lambda c: put_together(c, quoted)))

    def of_masked(m: Column) -> Column:
        return bind(clauses(m["text"]), lambda cut: of_clauses(cut, m["quoted"]))

    # the cheap tests come first, as most texts fail them
    possible = ~q.rlike(NO_LOOKUP_WORD) & (F.size(sql_tables(q)) == 1)
    return F.when(possible, bind(masked(q), of_masked))


def sql_tags(sql: Column) -> Column:
    """Tags of a SQL text in their fixed order; a text without any may be a lookup."""
    def found(blanked: Column, outside_joins: Column) -> Column:
        return F.array_compact(
            F.array(
                F.when(blanked.rlike(AGGREGATE_WORD), TAGS[0]),
                F.when(blanked.rlike(EXTREME_WORD), TAGS[1]),
                F.when(blanked.rlike(JOIN_WORD), TAGS[2]),
                F.when(blanked.rlike(ORDER_WORD), TAGS[3]),
                F.when(outside_joins.rlike(NUMBER_AFTER_OPERATOR) | outside_joins.rlike(NUMBER_BEFORE_OPERATOR), TAGS[4]),
            )
        )

    def of_line(q: Column) -> Column:
        tags = bind(
            F.regexp_replace(q, QUOTED_TEXT, "''"),
            lambda blanked: bind(F.regexp_replace(blanked, JOIN_CONDITION, "$1"), lambda outside: found(blanked, outside)),
        )
        lookup = F.array(F.lit(LOOKUP_TAG))
        return bind(tags, lambda t: F.when(F.size(t) > 0, t).when(_line_is_lookup(q), lookup).otherwise(t))

    return bind(one_line(sql), of_line)


def sql_type(tags: Column) -> Column:
    return F.array_join(tags, ",")


def is_pure_lookup(tags: Column) -> Column:
    return tags == F.array(F.lit(LOOKUP_TAG))


def unquote(text: Column) -> Column:
    """A name or literal without its quotes."""
    return bind(
        F.trim(text),
        lambda t: F.when(t.rlike(r"(?s)^('.*'|\".*\"|`.*`|\[.*\])$"), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t),
    )


def bare_name(text: Column) -> Column:
    """Column name without quotes and without a table prefix."""
    return bind(
        F.trim(text), lambda t: F.when(t.rlike(r"^\w+\.\w+$"), F.regexp_extract(t, r"\.(\w+)$", 1)).otherwise(unquote(t))
    )


def where_text(sql: Column) -> Column:
    line = F.rtrim(one_line(sql), F.lit("; "))
    return bind(masked(line), lambda m: F.trim(F.rtrim(unmasked(clause(clauses(m["text"]), "where"), m["quoted"]), F.lit(";"))))


PREDICATES = "array<struct<col:string,op:string,args:array<string>>>"


def predicates(where: Column) -> Column:
    """AND-ed comparisons of a WHERE text as ARRAY<STRUCT<col, op, args>>; args are unquoted literals.

    NULL when the text is more than that, and empty when there is none.
    """
    return bind(masked(where), lambda m: _masked_predicates(m["text"], m["quoted"]))


def _masked_predicates(text: Column, quoted: Column) -> Column:
    """Predicates of a masked text: cut at AND (the one inside BETWEEN is no cut), each read by its operator word."""
    ranged = F.regexp_replace(text, r"(?i)(\bbetween\s+\S+)\s+and\s+", f"$1{RANGE_SIGN}")

    def read(item: Column) -> Column:
        # the operator is the first one of the four; what stands before it has to be a name
        op = F.lower(F.regexp_extract(item, r"(?i)(=|\blike\b|\bbetween\b|\bin\b)", 1))
        cut = F.split(item, r"(?i)\s*(?:=|\blike\b|\bbetween\b|\bin\b)\s*", 2)
        rest = F.trim(F.get(cut, F.lit(1)))
        inside = F.substring(rest, F.lit(2), F.length(rest) - 2)
        args = (
            F.when(op == "between", F.split(rest, RANGE_SIGN))
            .when((op == "in") & F.startswith(rest, F.lit("(")) & F.endswith(rest, F.lit(")")), F.split(inside, ","))
            .when(op.isin("=", "like"), F.array(rest))
            .otherwise(F.array().cast("array<string>"))
        )
        return F.struct(F.trim(F.get(cut, F.lit(0))).alias("name"), op.alias("op"), _all_trimmed(args).alias("args"))

    def whole(p: Column) -> Column:
        counted = F.when(p["op"] == "between", F.size(p["args"]) == 2).otherwise(F.size(p["args"]) > 0)
        return (p["op"] != "") & _is_name(p["name"]) & counted & F.forall(p["args"], _is_value)

    def shown(p: Column) -> Column:
        back = lambda item: unmasked(item, quoted)
        return F.struct(
            bare_name(back(p["name"])).alias("col"), p["op"].alias("op"), F.transform(p["args"], lambda a: unquote(back(a))).alias("args")
        )

    items = F.transform(F.split(ranged, r"(?i)\s+and\s+"), read)
    none = F.array().cast(PREDICATES)
    found = bind(items, lambda ps: F.when(F.forall(ps, whole), F.transform(ps, shown)))
    return F.when(F.trim(text) == "", none).otherwise(found)


def select_list(sql: Column) -> Column:
    """The text between SELECT and FROM."""
    return bind(masked(one_line(sql)), lambda m: unmasked(clause(clauses(m["text"]), "select"), m["quoted"]))


def is_distinct(sql: Column) -> Column:
    return one_line(sql).rlike(r"(?i)\bselect\s+distinct\b")


def limit_of(sql: Column) -> Column:
    """Row limit at the end of the text, NULL without one."""
    return F.nullif(F.regexp_extract(F.rtrim(one_line(sql), F.lit("; ")), r"(?i)\blimit\s+(\d+)$", 1), F.lit("")).cast("bigint")


# One aggregate over one table, e.g.
#   SELECT g, SUM(x) FROM t WHERE .. GROUP BY g ORDER BY SUM(x) DESC LIMIT 3
COLUMN = r"(?:[\w.]+|`[^`]+`|\"[^\"]+\"|\[[^\]]+\])"
AGG_CALL = r"(sum|avg|count|min|max)\s*\(\s*(\*|" + COLUMN + r")\s*\)"


GROUPED_BY = rf"(?i)\bgroup by\s+({COLUMN})\s*(?:\border by\b.*|\blimit\b.*)?$"
ORDERED_BY = r"(?i)\border by\s+(.*?)(?:\blimit\b.*)?$"
PLAIN_ORDER = rf"(?i)^(?:{AGG_CALL}|{COLUMN})(?:\s+(?:asc|desc))?$"


def aggregate_spec(sql: Column) -> Column:
    """Struct describing a single-table aggregate, NULL for other texts.

    ``shows`` says what the select list holds: ``group``, ``value``, ``both``.
    """
    def pieces(q: Column) -> Column:
        return F.struct(
            q.alias("q"),
            F.trim(select_list(q)).alias("listed"),
            F.regexp_extract(q, GROUPED_BY, 1).alias("grouping"),
            F.trim(F.regexp_extract(q, ORDERED_BY, 1)).alias("ordering"),
            predicates(where_text(q)).alias("preds"),
            F.upper(q).alias("up"),
        )

    def calls(p: Column) -> Column:
        call = lambda text: F.regexp_extract(text, f"(?i){AGG_CALL}", 0)
        return F.struct(p.alias("p"), call(p["listed"]).alias("listed_call"), call(p["ordering"]).alias("ordered_call"))

    return bind(bind(F.rtrim(one_line(sql), F.lit("; ")), pieces), lambda p: bind(calls(p), _spec_of))


def _spec_of(c: Column) -> Column:
    p, listed_call, ordered_call = c["p"], c["listed_call"], c["ordered_call"]
    q, grouping, ordering = p["q"], p["grouping"], p["ordering"]
    grouped = grouping != ""
    shows = (
        F.when(p["listed"].rlike(rf"(?i)^{AGG_CALL}$"), "value")
        .when(grouped & (F.lower(bare_name(p["listed"])) == F.lower(bare_name(grouping))), "group")
        .when(grouped & p["listed"].rlike(rf"(?i)^{COLUMN}\s*,\s*{AGG_CALL}$"), "both")
    )
    unspaced = lambda text: F.lower(F.regexp_replace(text, " ", ""))
    ok = (
        ((listed_call != "") | (ordered_call != ""))
        & shows.isNotNull()
        & p["preds"].isNotNull()
        & ((ordering == "") | ordering.rlike(PLAIN_ORDER))
        & ((listed_call == "") | (ordered_call == "") | (unspaced(listed_call) == unspaced(ordered_call)))
        & (grouped | ~q.rlike(r"(?i)\bgroup by\b"))
        & ~q.rlike(r"(?i)\b(join|union|intersect|except|having)\b")
        & (F.size(sql_tables(p["up"])) == 1)
        & (F.size(F.regexp_extract_all(p["up"], F.lit(r"\bSELECT\b"), F.lit(0))) == 1)
    )
    call = F.when(listed_call != "", listed_call).otherwise(ordered_call)
    return F.when(
        ok,
        F.struct(
            F.lower(F.regexp_extract(call, f"(?i){AGG_CALL}", 1)).alias("func"),
            bare_name(F.regexp_extract(call, f"(?i){AGG_CALL}", 2)).alias("target"),
            F.when(grouped, bare_name(grouping)).alias("group_col"),
            shows.alias("shows"),
            F.when(ordering == "", "none").when(ordered_call != "", "value").otherwise("group").alias("order_by"),
            ordering.rlike(r"(?i)\bdesc$").alias("descending"),
            limit_of(q).alias("row_limit"),
            p["preds"].alias("preds"),
        ),
    )
