"""Column functions as Spark SQL text: each takes the SQL text of a cell and returns the
SQL text of the result, for ``F.expr`` or ``selectExpr``.

Text composes without a driver round trip per operator, and a column costs one parse.
Normalisers and date parsing expect cells that an earlier projection has stripped, as the
cleaning chain does: an expression that is used many times belongs in a column of its own.
Built-in functions only, so everything stays in generated code. The common case of a cell
(printable ASCII at both ends, a plain number, an ISO date) is tested first, because the
general form of each function is many times slower.
"""
