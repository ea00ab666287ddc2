"""Registered JDBC databases, readable in queries as name.schema.table."""

from __future__ import annotations

import re

from stratum.functions.types import Refused, identifier

_SECRETS = re.compile(r"(password|passwd|pwd|secret)(\s*[=:]\s*)([^;&\s'\"]+|'[^']*'|\"[^\"]*\")", re.I)


def redacted(text: str, *secrets: str) -> str:
    """The text without passwords, in URLs or wherever a known secret stands."""
    out = _SECRETS.sub(r"\1\2***", text)
    for s in filter(None, secrets):
        out = out.replace(s, "***")
    return re.sub(r"(//[^/:@\s]+:)[^@\s]+@", r"\1***@", out)


class Federation:
    def __init__(self, warehouse):
        self.w = warehouse
        self.secrets: dict[str, str] = {}

    def register(self, name: str, url: str, user: str = "", password: str = "", driver: str = "") -> None:
        """Attach a database. Only its address is in the catalog; the password stays in this process. Reads only, as the gate lets nothing else pass."""
        identifier(name, "connection")
        conf, prefix = self.w.spark.conf, f"spark.sql.catalog.{name}"
        conf.set(prefix, "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog")
        for key, value in (("url", url), ("user", user), ("password", password), ("driver", driver)):
            if value:
                conf.set(f"{prefix}.{key}", value)
        self.secrets[name] = password
        self.w.catalog.put_connection(name, {"url": redacted(url), "user": user, "driver": driver})

    def drop(self, name: str) -> None:
        self.w.catalog.put_connection(name, None)
        self.secrets.pop(name, None)
        for key in ("", ".url", ".user", ".password", ".driver"):
            self.w.spark.conf.unset(f"spark.sql.catalog.{name}{key}")

    def probe(self, name: str, query: str = "SELECT 1") -> None:
        """Reads one row; Refused with a message without secrets if it can't."""
        conf, prefix = self.w.spark.conf, f"spark.sql.catalog.{name}"
        options = {k: v for k in ("url", "user", "password", "driver") if (v := conf.get(f"{prefix}.{k}", ""))}
        try:
            self.w.spark.read.format("jdbc").options(**options, query=query, queryTimeout="10").load().limit(1).collect()
        except Exception as error:  # noqa: BLE001
            raise Refused("connection_failed", redacted(str(error), self.secrets.get(name, ""))[:500]) from None
