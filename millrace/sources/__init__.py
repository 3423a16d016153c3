"""Encodings of rows, and reading and writing them."""

from . import base, binary, csvtext, jsontext, sexpr
from .base import Codec, DecodeProblem, codec, decode_column, encode_column, read, register, sizes, write

__all__ = ["Codec", "DecodeProblem", "base", "binary", "codec", "csvtext", "decode_column", "encode_column", "jsontext", "read", "register", "sexpr", "sizes", "write"]
