"""The vectorised text handling of the core, for the operators of this package."""

from ..functions.kernel import LETTER, LONG_WORD, NUMBER, OTHER, SPACE, WHITE_SPACE, classes, code_points, gather, hashes, lower_table, mix, runs, slices

__all__ = ["LETTER", "LONG_WORD", "NUMBER", "OTHER", "SPACE", "WHITE_SPACE", "classes", "code_points", "gather", "hashes", "lower_table", "mix", "runs", "slices"]
