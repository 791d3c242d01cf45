"""Texts that prompts are made of."""

from __future__ import annotations

# Question-answering, text-to-SQL and judge prompts, whose wording decides
# the replies.  Names in braces are filled in; doubled braces stand for single ones.
QA_TABLE_INTRO = (
    "You are an expert at table question answering. You need to extract answers "
    "based on the following information:\n\n"
)
QA_TEXT_INTRO = (
    "You are an expert at question answering. You need to extract answers "
    "based on the following information:\n\n"
)
QA_TABLES_MARK = "[Tables]\n"
QA_EXTRA_MARK = "[Additional Information]\n"
QA_TEXT_MARK = "[Textual Information]\n"
QA_QUESTION_MARK = "[Question]\n"
QA_ENDING = (
    "Please return your answer in JSON format only, with no explanation, "
    'following this structure:\n{"Answer": "[your answer]"}'
)
QA_VIEWS = ["semi-structured", "structured", "unstructured"]

SQL_SYSTEM = """You are a careful NL2SQL expert for {dialect}.
Rules:
- Return a single SQL query that answers the question.
- Use ONLY provided tables/columns.
- Prefer explicit JOINs with ON.
- If ambiguous, make the least risky assumption and add a short <!--note--> comment.
- Use {dialect} syntax.
- Output ONLY SQL inside one fenced block:
```sql
SELECT ...
```
"""
SQL_USER = """{dialect} schema & preview:
{schema_md}

Question:
{question}

Constraints:
- Only SELECT is allowed.
- If dates like "last month" appear, assume today is {today}.
"""
SQL_REPAIR = (
    "Your SQL failed with this {dialect} error:\n{error}\n\n"
    "Please return a corrected SQL (one fenced block). Remember: only SELECT."
)
JUDGE = """You are an expert in evaluating question answering results.

[Ground-truth Answer]
{truth}

[Model Prediction]
{prediction}

Is the prediction semantically equivalent to the ground-truth answer? 
Please respond with only one word: "CORRECT" or "INCORRECT".
"""
NO_TABLES = "_(No tables)_"
NO_COLUMNS = "_(no columns)_"

# Default request texts in this project's own words; a file of the user's can take their place.
COMBINATION_RULES = {
    "several": "pick two to five combinations of several columns each",
    "1": "make every combination a single column",
    "3": "make every combination exactly three columns",
    "6": "make every combination exactly six columns",
    "all": "give one combination only, holding all columns marked YES; a single column is fine",
}
COLUMN_REQUEST = """Below are the columns of one database table with a few of their values.

First decide for each column whether people would mention it when they describe a row.
Mark it YES if it reads as a fact (a name, a place, an amount, a state), and NO if it only
serves the system (keys, technical stamps, links).

Then combine columns marked YES so that each combination could be told in one sentence:
{rule}.
Use no column twice in a combination.

Database: {db}
Table: {table}
Columns:
{cols}

Reply with one JSON object:
```json
{{"column_classification": {{"<column>": "YES or NO"}}, "combinations": [["<column>", "<column>"]]}}
```
"""
TEMPLATE_REQUEST = """Write five different English sentences, each of which tells one row of a table.

Database: {db}
Table: {table}
Columns to tell, each exactly once per sentence as {{{{column}}}}: {sel_cols}

Values these and other columns hold:
{example_block}

Use no other column. Keep the sentences short and natural.
Reply with one JSON object that has the keys template1 to template5, for example
{{"template1": "{{{{city}}}} lies in {{{{country}}}}.", "template2": "..."}}
"""
ENRICHMENT_REQUEST = """Here is a row of a table:
{row}

And a sentence about it:
"{description}"

Tell the same in about 50 words with fitting background. Keep every fact of the sentence,
add nothing that contradicts the row, and reply with the new text only.
"""
