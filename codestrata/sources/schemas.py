"""Explicit schemas of the corpus relations for ``load``; nothing is inferred."""

PROBLEM = (
    "index string, tags array<string>, solutions array<struct<index:string,code:string,raw:string,tokens:array<string>>>, "
    "contest_name string, difficulty string"
)

SOLUTION = "index string, raw string, code string, tokens array<string>, tags array<string>, Y array<int>"

EMBEDDING_ROW = "index string, label string, embeddings array<array<double>>"

FUNCTION = (
    "id long, project string, compiler string, optimization string, file_name string, function_name string, "
    "asm string, num_instructions int"
)

INSTRUCTIONS = "id long, instr array<bigint>"
