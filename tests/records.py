"""Records of a small corpus, in the loose shapes that readers have to take."""

RECORDS = [
    {
        "id_": "s1",
        "db": "shop",
        "Question": "What did the blue lamp cost?",
        "answer": [["12.5"]],
        "SQL": "SELECT price FROM goods WHERE name = 'lamp' AND colour = 'blue'",
        "table_names": ["goods", "lost"],
        "tables": [
            {
                "table_columns": ["name", "colour", "price", "stock", "sold"],
                "table_content": [
                    ["lamp", "red", 10.0, 3, True],
                    ["lamp", "blue", 12.5, None, False],
                    ["lamp", "blue"],
                    ["chair", "", 40, 7, True, "beyond the header"],
                    [None, "green", 5, 0, None],
                ],
            }
        ],
    },
    {
        "id": "s2",
        "db": "shop",
        "question": "Which colour sells most?",
        "answer": "red",
        "SQL": "SELECT colour FROM goods GROUP BY colour ORDER BY SUM(stock) DESC LIMIT 1;",
        "table_names": ["goods"],
        "tables": [
            {
                "table_columns": ["name", "colour", "price", "stock", "note, long"],
                "table_content": [["desk", "red", 99, 4, "a {colour} desk"], ["bench", "red", 55, 1, None], ["sofa", "grey", 400, 2, "x"]],
            }
        ],
    },
    {"SQL": "SELECT 1", "table_names": ["empty"], "tables": [{"table_columns": ["a"], "table_content": []}]},
    {
        "id_": "s4",
        "db": "office",
        "Question": "?",
        "answer": None,
        "table_names": ["goods"],
        "tables": [{"table_columns": [["top", ""], ["left", "right"]], "table_content": [["1", "2"]]}],
        "verbalized_data": [{"text": "One."}, {"text": "Two."}],
    },
]
