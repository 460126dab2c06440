"""What models are asked, and the shape of their replies, as data."""

from __future__ import annotations

ANSWER = """Answer from the numbered excerpts alone. Where they don't hold enough, say what is missing.
If the question can be answered with yes or no, the first line is exactly "Short answer: Yes" or "Short answer: No", and a blank line follows.
Name the excerpts that a statement rests on."""

SPLIT = """Does the question ask for several things? Write each as a question of its own that needs no other, at most {most}, one a line, each line beginning with SUBQ:
A question that asks for one thing is one line."""

HYDE = "Write the paragraph that a reference book would have about this question: plain prose, the field's own terms, no introduction."

UNDERSTAND = """You prepare questions for search in this collection: {corpus}. Don't answer the question.
Reply with one JSON object: "language" is the code of the question's language, "translation" the question in {language} (empty if it is in it already), "query" one plain question in the collection's language, with the terms that the collection would use and Sanskrit in IAST."""

CHECK = """Does every statement of the draft follow from the excerpts? Reply with one JSON object: "supported" (true or false), "unsupported_claims" (a list of the statements that don't), "refine_query" (a question that would find what is missing, or null)."""

RECOGNISE = """Transcribe the page as blocks in reading order. Boxes are [ymin, xmin, ymax, xmax] in thousandths of the page. Give each word its box, its language and its style; a footnote names the block it belongs to."""

TRANSLATE = """Translate each block from {source} into {target}, each as a whole. What stands in [[ ]] stays as it is, within its brackets; so do <sup> marks. Leave these terms as they are: {terms}
Every block's id comes back exactly once."""

_BOX = {"type": "array", "items": {"type": "integer"}, "minItems": 4, "maxItems": 4}

#: The JSON schema of a recognised page.
PAGE_SCHEMA = {
    "type": "object",
    "required": ["blocks"],
    "properties": {
        "printed_page_number": {"type": ["string", "null"]},
        "blocks": {
            "type": "array",
            "items": {
                "type": "object",
                "required": ["block_id", "type", "box", "words"],
                "properties": {
                    "block_id": {"type": "string"},
                    "type": {"type": "string", "enum": ["sutra", "paragraph", "heading", "footnote", "list_item", "quote", "caption", "running_header", "running_footer", "page_number", "other"]},
                    "box": _BOX,
                    "parent_block_id": {"type": ["string", "null"]},
                    "continues_from_previous_page": {"type": "boolean"},
                    "words": {"type": "array", "items": {"type": "object", "required": ["t", "box"], "properties": {"t": {"type": "string"}, "box": _BOX, "lang": {"type": "string"}, "style": {"type": "string"}}}},
                },
            },
        },
    },
}

#: The JSON schema of translated blocks.
TRANSLATION_SCHEMA = {"type": "object", "required": ["translations"], "properties": {"translations": {"type": "array", "items": {"type": "object", "required": ["id", "text"], "properties": {"id": {"type": "string"}, "text": {"type": "string"}}}}}}

#: The same page as a Spark schema, for from_json and the blocks' builder.
PAGE_BLOCKS = "array<struct<block_id: string, type: string, box: array<int>, parent_block_id: string, continues_from_previous_page: boolean, words: array<struct<t: string, box: array<int>, lang: string, style: string>>>>"
