"""Permission bits and password hashes as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Permission bits (fixed values).
PERMISSIONS = {"READ": 1, "CREATE": 2, "UPDATE": 3, "DELETE": 4, "ALL": 0xFF}


def check_permission(held: Column, wanted: int) -> Column:
    return held.bitwiseAND(wanted) == wanted


def hash_password(password: Column, salt: Column) -> Column:
    return F.sha2(F.concat(password, salt), 256)


def expires_at(minutes: int) -> Column:
    return F.current_timestamp() + F.make_interval(mins=F.lit(minutes))
