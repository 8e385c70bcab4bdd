"""Row scope, the filter algebra, sort whitelist and paging."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.schema import QUALIFIED


#: Identifiers in a condition up to which they are literals.
MOST_LITERALS = 50


@dataclass(frozen=True)
class Scope:
    """Who asks: everything, one organisation, or (blank) nothing at all."""

    org_id: str | None = None
    view_all: bool = False

    def predicate(self, column: str = "org_id") -> Column:
        org = (self.org_id or "").strip()
        if self.view_all:
            return F.lit(True)
        return F.col(column) == org if org else F.lit(False)

    def apply(self, df: DataFrame, column: str = "org_id") -> DataFrame:
        """The rows in scope. A missing organisation sees no rows."""
        return df.where(self.predicate(column))

    def may_see(self, org_id: str | None) -> bool:
        org = (self.org_id or "").strip()
        return org_id is not None if self.view_all else bool(org) and org == org_id


def same_scope(a: Column, b: Column) -> Column:
    x, y = F.trim(F.coalesce(a, F.lit(""))), F.trim(F.coalesce(b, F.lit("")))
    return x == y


@dataclass(frozen=True)
class RecordFilter:
    """All conditions are ANDed; a blank one is left out."""

    registration_no: str | None = None
    outpatient_no: str | None = None
    gender: str | None = None
    department: str | None = None
    doctor_id: str | None = None
    grade: str | None = None
    status: str | None = None
    pattern: str | None = None
    visit_range: tuple[str, str] | None = None
    create_range: tuple[str, str] | None = None
    only_unparsed: bool = False
    only_uncleaned: bool = False
    ids: tuple = field(default_factory=tuple)
    #: User text with % or _ matches literally unless this is set.
    raw_wildcards: bool = False

    @classmethod
    def from_map(cls, values: dict) -> RecordFilter:
        """Unknown keys are ignored; blanks and the text "null" are no condition."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v.strip() if isinstance(v, str) else v for k, v in values.items() if k in known and v is not None and not (isinstance(v, str) and v.strip() in ("", "null"))})

    def predicate(self) -> Column:
        out = F.lit(True)
        for name in ("registration_no", "outpatient_no"):
            if text := (getattr(self, name) or "").strip():
                out &= F.col(name).like(f"%{text}%") if self.raw_wildcards else F.col(name).contains(text)
        for name in ("gender", "department", "doctor_id", "grade", "status", "pattern"):
            if text := (getattr(self, name) or "").strip():
                out &= F.col(name) == text
        for name, days in (("visit_time", self.visit_range), ("create_time", self.create_range)):
            if days and all(days):
                first, last = (F.to_timestamp_ntz(F.lit(f"{d} {t}")) for d, t in zip(days, ("00:00:00", "23:59:59"), strict=True))
                out &= F.col(name).between(first, last)
        if self.only_unparsed:
            out &= F.col("structured_data").isNull()
        if self.only_uncleaned:
            out &= ~F.col("governed")
        if 0 < len(self.ids) <= MOST_LITERALS:
            out &= F.col("id").isin(*self.ids)
        return out

    def describe(self) -> str:
        """The conditions in words, for the audit log."""
        parts = [f"{f.name}={getattr(self, f.name)}" for f in fields(self) if f.name != "raw_wildcards" and getattr(self, f.name)]
        return " · ".join(parts) or "all"

    def apply(self, df: DataFrame) -> DataFrame:
        """Rows that meet all conditions; a long list of ids is a table that they are joined with."""
        out = df.where(self.predicate())
        if len(self.ids) > MOST_LITERALS:
            wanted = df.sparkSession.createDataFrame([(i,) for i in self.ids], df.select("id").schema)
            out = out.join(wanted.distinct(), "id", "left_semi")
        return out

    def guard_delete(self) -> None:
        """A delete without any condition is refused."""
        if self.describe() == "all":
            raise ValueError("a delete needs a condition")


def cleaning_filter(user: RecordFilter) -> RecordFilter:
    """A user's filter as cleaning takes it: the grade is always qualified, an import range is dropped."""
    return replace(user, grade=QUALIFIED, create_range=None)


def for_cleaning(df: DataFrame, user: RecordFilter | None = None) -> DataFrame:
    return cleaning_filter(user or RecordFilter()).apply(df)


def for_export(df: DataFrame) -> DataFrame:
    return df.where((F.col("grade") == QUALIFIED) & F.col("governed"))


SORTABLE = {"score": "score", "visit_time": "visit_time", "visitTime": "visit_time", "registration_no": "registration_no", "registrationNo": "registration_no"}


def sort_order(by: str | None = None, direction: str | None = None) -> list[Column]:
    """A total order from user input; what is not on the list gives the default, latest visit first."""
    name = SORTABLE.get(by or "")
    if name is None:
        return [F.col("visit_time").desc_nulls_last(), F.col("id").asc()]
    default = "asc" if name == "registration_no" else "desc"
    if (direction or default).lower() == "asc":
        return [F.col(name).asc_nulls_last(), F.col("id").asc()]
    return [F.col(name).desc_nulls_last(), F.col("id").desc() if by else F.col("id").asc()]


def page(df: DataFrame, order: list[Column], number: int = 1, size: int | None = 20) -> DataFrame:
    size = page_size(size)
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def page_size(size: int | None) -> int:
    return 1 if size is None else min(max(size, 1), 500)


def keyset_page(df: DataFrame, after: tuple[Column, Column] | None, size: int) -> DataFrame:
    """The next rows in (visit_time desc, id) order after a (time, id) cursor; rows without a time come last."""
    if after is not None:
        time, key = after
        v = F.col("visit_time")
        df = df.where((v < time) | ((v == time) & (F.col("id") > key)) | (v.isNull() & time.isNotNull()) | (v.isNull() & time.isNull() & (F.col("id") > key)))
    return df.orderBy(*sort_order()).limit(size)


def keyword(df: DataFrame, text: str, columns: tuple[str, ...] = ("operator", "target", "detail")) -> DataFrame:
    """Rows in which any of the columns holds the text."""
    found = F.lit(False)
    for c in columns:
        found |= F.coalesce(F.col(c).contains(text), F.lit(False))
    return df.where(found)


def log_predicate(role: str, operator: str, org_id: str | None) -> Column:
    """Admins see all logs, owners their organisation's, members their own there, others their own."""
    own = F.col("operator") == operator
    org = F.col("org_id") == (org_id or "")
    return {"admin": F.lit(True), "owner": org, "member": org & own}.get(role, own)


def visible_logs(df: DataFrame, role: str, operator: str, org_id: str | None) -> DataFrame:
    return df.where(log_predicate(role, operator, org_id))


def visible_tasks(df: DataFrame, scope: Scope, status: str | None = None, overdue_at: Column | None = None) -> DataFrame:
    out = scope.apply(df).where(~F.col("is_obsolete"))
    if status:
        out = out.where(F.col("status") == status)
    if overdue_at is not None:
        out = out.where((F.col("status") == "pending") & (F.col("deadline_time") < overdue_at))
    return out


def delete_by_filter(records: DataFrame, tasks: DataFrame, scope: Scope, condition: RecordFilter) -> tuple[DataFrame, DataFrame]:
    """Both tables without the matching records in scope and their tasks."""
    condition.guard_delete()
    gone = condition.apply(scope.apply(records)).select("id")
    return records.join(gone, "id", "left_anti"), tasks.join(gone, tasks["record_id"] == gone["id"], "left_anti")
