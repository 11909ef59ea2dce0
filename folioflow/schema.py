"""The fifteen tables of the document store: types, keys, references, and the domains of their constants."""

from __future__ import annotations

from pyspark.sql import types as T

# The tables, as the documents that are moved here have them.
TABLE_DDL: dict[str, str] = {
    "documents": (
        "id string not null, title string not null, filePath string not null, sha256 string not null, importedAt bigint not null, "
        "lastOpenedAt bigint not null, pageCount int not null, processedPages int not null, status string not null, errorMessage string, "
        "aiContextStatus string not null, aiContextSummary string, aiContextError string, aiContextCostCurrency string not null, "
        "aiContextCostAmount string not null, aiContextPromptTokens int not null, aiContextCompletionTokens int not null, "
        "fullTranslationStatus string not null, fullTranslationCompleted int not null, fullTranslationTotal int not null, "
        "fullTranslationCorrectedCount int not null, fullTranslationError string, fullTranslationCostCurrency string not null, "
        "fullTranslationCostAmount string not null, fullTranslationPromptTokens int not null, fullTranslationCompletionTokens int not null, "
        "folderId string, isTrashed boolean not null"
    ),
    "page_layout_blocks": (
        "documentId string not null, pageNumber int not null, position int not null, type string not null, text string not null, left float not null, "
        "top float not null, right float not null, bottom float not null, confidence float not null"
    ),
    "page_evidence": (
        "id string not null, documentId string not null, pageNumber int not null, channel string not null, kind string not null, "
        "position int not null, parentId string, blockType string, modelId string, text string not null, left float not null, top float not null, "
        "right float not null, bottom float not null, confidence float not null, imagePng binary"
    ),
    "folders": "id string not null, name string not null, createdAt bigint not null",
    "tags": "id string not null, name string not null",
    "document_tags": "documentId string not null, tagId string not null",
    "pages": (
        "documentId string not null, pageNumber int not null, widthPoints float not null, heightPoints float not null, source string not null, "
        "textQuality float not null"
    ),
    "sentences": (
        "id string not null, documentId string not null, pageNumber int not null, position int not null, originalText string not null, "
        "correctedText string, regions string not null, source string not null, confidence float not null"
    ),
    "sentence_spans": "sentenceId string not null, position int not null, kind string not null, text string not null",
    "translations": (
        "sentenceId string not null, sourceText string not null, translatedText string not null, promptTokens int not null, "
        "cacheHitTokens int not null, cacheMissTokens int not null, completionTokens int not null, costCurrency string not null, "
        "costAmount string not null, updatedAt bigint not null"
    ),
    "ai_correction_reviews": (
        "sentenceId string not null, documentId string not null, pageNumber int not null, pdfOriginalText string not null, parsedText string not null, "
        "proposedText string not null, translatedText string not null, createdAt bigint not null"
    ),
    "annotation_strokes": (
        "id string not null, documentId string not null, pageNumber int not null, tool string not null, color bigint not null, width float not null, "
        "pressureEnabled boolean not null, points string not null, controlPoints string not null, createdAt bigint not null"
    ),
    "sentence_note_strokes": (
        "id string not null, sentenceId string not null, tool string not null, color bigint not null, width float not null, "
        "pressureEnabled boolean not null, points string not null, controlPoints string not null, createdAt bigint not null"
    ),
    "vocabulary": "id string not null, word string not null, normalizedWord string not null, note string not null, sourceSentenceId string, createdAt bigint not null",
    "app_settings": "key string not null, value string not null",
}

# What a column holds that a row does not give.
DEFAULTS: dict[str, dict[str, object]] = {
    "documents": {
        "processedPages": 0, "status": "QUEUED", "aiContextStatus": "NOT_REQUESTED", "aiContextCostCurrency": "", "aiContextCostAmount": "0", "aiContextPromptTokens": 0, "aiContextCompletionTokens": 0,
        "fullTranslationStatus": "NOT_STARTED", "fullTranslationCompleted": 0, "fullTranslationTotal": 0, "fullTranslationCorrectedCount": 0, "fullTranslationCostCurrency": "", "fullTranslationCostAmount": "0",
        "fullTranslationPromptTokens": 0, "fullTranslationCompletionTokens": 0, "isTrashed": False,
    },
    "translations": {"promptTokens": 0, "cacheHitTokens": 0, "cacheMissTokens": 0, "completionTokens": 0, "costCurrency": "", "costAmount": "0"},
}

S, B = T.StringType(), T.BooleanType()
_TYPES = {"string": S, "int": T.IntegerType(), "bigint": T.LongType(), "float": T.FloatType(), "boolean": B, "binary": T.BinaryType()}


def table_type(ddl: str) -> T.StructType:
    """The type of a table from `name type [not null]`, separated by commas."""
    words = [c.split() for c in ddl.split(", ")]
    return T.StructType([T.StructField(w[0], _TYPES[w[1]], len(w) == 2) for w in words])


TABLES: dict[str, T.StructType] = {name: table_type(ddl) for name, ddl in TABLE_DDL.items()}

# Primary keys, further unique keys, and references whose rows go when their parent goes.
KEYS: dict[str, tuple[str, ...]] = {
    "documents": ("id",), "page_layout_blocks": ("documentId", "pageNumber", "position"), "page_evidence": ("id",), "folders": ("id",), "tags": ("id",), "document_tags": ("documentId", "tagId"),
    "pages": ("documentId", "pageNumber"), "sentences": ("id",), "sentence_spans": ("sentenceId", "position"), "translations": ("sentenceId",), "ai_correction_reviews": ("sentenceId",),
    "annotation_strokes": ("id",), "sentence_note_strokes": ("id",), "vocabulary": ("id",), "app_settings": ("key",),
}

UNIQUE: dict[str, tuple[tuple[str, ...], ...]] = {
    "documents": (("sha256",),), "page_evidence": (("documentId", "pageNumber", "channel", "position"),), "folders": (("name",),), "tags": (("name",),),
    "sentences": (("documentId", "pageNumber", "position"),), "vocabulary": (("normalizedWord",),),
}

# child -> (its column, parent, the parent's column): rows go when their parent goes.
CASCADES: dict[str, tuple[str, str, str]] = {
    "page_layout_blocks": ("documentId", "documents", "id"), "page_evidence": ("documentId", "documents", "id"), "pages": ("documentId", "documents", "id"),
    "sentences": ("documentId", "documents", "id"), "annotation_strokes": ("documentId", "documents", "id"), "sentence_spans": ("sentenceId", "sentences", "id"),
    "translations": ("sentenceId", "sentences", "id"), "ai_correction_reviews": ("sentenceId", "sentences", "id"), "sentence_note_strokes": ("sentenceId", "sentences", "id"),
}

# The constants that columns may hold.
DOCUMENT_STATUS = ("QUEUED", "INDEXING", "PAUSED", "CANCELED", "READY", "FAILED")
AI_CONTEXT_STATUS = ("NOT_REQUESTED", "SKIPPED", "PENDING", "ANALYZING", "READY", "FAILED")
TRANSLATION_STATUS = ("NOT_STARTED", "RUNNING", "READY", "FAILED")
SPAN_KIND = ("TEXT", "INLINE_FORMULA", "DISPLAY_FORMULA")
CHANNELS = ("PDF_RUST", "PDF_ANDROID", "VISUAL_LAYOUT", "VISUAL_OCR", "VISUAL_FORMULA")
EVIDENCE_KIND = ("TEXT_REGION", "RAW_TEXT_CONTENT", "WORD", "LAYOUT_BLOCK", "OCR_LINE", "OCR_GLYPH", "FORMULA_REGION", "FORMULA_LATEX", "IMAGE_ALT")
LAYOUT_LABELS = (
    "abstract", "algorithm", "aside_text", "chart", "content", "display_formula", "doc_title", "figure_title", "footer", "footer_image", "footnote", "formula_number", "header", "header_image", "image",
    "inline_formula", "number", "paragraph_title", "reference", "reference_content", "seal", "table", "text", "vertical_text", "vision_footnote",
)
BLOCK_TYPE_OF_LABEL = {
    "doc_title": "DOCUMENT_TITLE", "content": "CONTENTS", "paragraph_title": "SECTION_TITLE", "abstract": "ABSTRACT", "reference": "REFERENCE", "reference_content": "REFERENCE", "footnote": "FOOTNOTE",
    "vision_footnote": "FOOTNOTE", "aside_text": "SIDEBAR", "figure_title": "CAPTION", "image": "IMAGE", "header_image": "IMAGE", "footer_image": "IMAGE", "seal": "IMAGE", "chart": "CHART", "table": "TABLE",
    "header": "HEADER", "footer": "FOOTER", "number": "PAGE_NUMBER", "display_formula": "EQUATION", "inline_formula": "EQUATION", "formula_number": "EQUATION",
}
OCR_LABELS = ("abstract", "algorithm", "aside_text", "content", "doc_title", "figure_title", "footer", "footnote", "header", "number", "paragraph_title", "reference", "reference_content", "text", "vertical_text", "vision_footnote")
SELECTABLE_LABELS = ("abstract", "algorithm", "aside_text", "content", "display_formula", "doc_title", "figure_title", "footnote", "paragraph_title", "reference", "reference_content", "text", "vertical_text", "vision_footnote")
IMAGE_BLOCK_TYPES = ("IMAGE", "CHART", "TABLE")
ROLE_OF_BLOCK = {
    "PARAGRAPH": "BODY", "EQUATION": "BODY", "ABSTRACT": "ABSTRACT", "REFERENCE": "REFERENCE", "CAPTION": "CAPTION", "DOCUMENT_TITLE": "TITLE", "SECTION_TITLE": "TITLE", "AUTHOR": "AUTHOR",
    "CONTENTS": "CONTENTS", "FOOTNOTE": "FOOTNOTE", "SIDEBAR": "SIDEBAR", "HEADER": "HEADER", "FOOTER": "FOOTER", "PAGE_NUMBER": "FOOTER",
}
FLOWING_ROLES = ("BODY", "ABSTRACT", "REFERENCE")

GLYPH = T.StructType([T.StructField("text", S), *(T.StructField(c, T.DoubleType()) for c in ("left", "top", "right", "bottom", "confidence"))])
LINE = T.StructType([T.StructField("text", S), *(T.StructField(c, T.DoubleType()) for c in ("left", "top", "right", "bottom", "confidence")), T.StructField("glyphs", T.ArrayType(GLYPH)), T.StructField("isFormula", B)])
