"""Arithmetic in text. It is parsed and walked, never run: neither Python's eval nor Spark's expr() sees it."""

import ast
import math
import operator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.fixed import MOST_EXPONENT, MOST_EXPRESSION

BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow}
UNARY = {ast.UAdd: operator.pos, ast.USub: operator.neg}


def value(node: ast.AST):
    match node:
        case ast.Constant(value=v) if type(v) in (int, float):
            return v
        case ast.UnaryOp(op=op, operand=inner) if type(op) in UNARY:
            return UNARY[type(op)](value(inner))
        case ast.BinOp(op=op, left=left, right=right) if type(op) in BINARY:
            a, b = value(left), value(right)
            if isinstance(op, ast.Pow) and abs(b) > MOST_EXPONENT:
                raise ValueError("the exponent is too large")
            return BINARY[type(op)](a, b)
    raise ValueError(f"{type(node).__name__} is not arithmetic")


def calculate(text: str | None) -> float | None:
    """The finite real value of an expression of numbers and + - * / // % **; null of anything else, too long, or undefined."""
    if not text or not text.strip() or len(text) > MOST_EXPRESSION:
        return None
    try:
        found = float(value(ast.parse(text.strip(), mode="eval").body))
    except (SyntaxError, ValueError, TypeError, ArithmeticError, RecursionError, MemoryError):
        return None
    return found if math.isfinite(found) else None


@F.pandas_udf(T.DoubleType())
def calculated(texts: pd.Series) -> pd.Series:
    return texts.map(calculate).astype("float64")
