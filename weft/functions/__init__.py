"""Column functions; arguments are names, columns or, where that makes sense, literals."""

from pyspark.sql.functions import lit as literal

from . import array, boxes, numeric, path, random, string
from .aggregate import any_value, avg, collect, concat, count, dense_rank, first, max, min, rank, row_number, sum
from .array import contains, cosine_distance, euclidean_distance, get_element, length, sip_hash_64
from .conditional import and_, case, greatest, ifelse, isnone, least, not_, or_
from .numeric import bit_and, bit_hamming_distance, bit_or, bit_xor, floor_divide, int_hash_64, shift_left, shift_right
from .path import file_ext, file_stem, name, parent
from .random import rand
from .string import byte_hamming_distance
from .window import over, window

__all__ = [
    "and_", "any_value", "array", "avg", "boxes", "bit_and", "bit_hamming_distance", "bit_or", "bit_xor", "byte_hamming_distance", "case", "collect", "concat", "contains",
    "cosine_distance", "count", "dense_rank", "euclidean_distance", "file_ext", "file_stem", "first", "floor_divide", "get_element", "greatest", "ifelse", "int_hash_64",
    "isnone", "least", "length", "literal", "max", "min", "name", "not_", "numeric", "or_", "over", "parent", "path", "rand", "random", "rank", "row_number", "shift_left",
    "shift_right", "sip_hash_64", "string", "sum", "window",
]
