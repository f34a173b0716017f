"""Column-level functions (JVM expressions) used by the operators."""

from adeptus.functions.text import (annotated_text, html_escape, legit_document, normalize_author,
                                    normalize_space, snippet, truncate)

__all__ = ["annotated_text", "html_escape", "legit_document", "normalize_author", "normalize_space",
           "snippet", "truncate"]
