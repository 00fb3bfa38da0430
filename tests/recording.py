"""A stand-in for a DB-API driver: statements are applied to lists in a file, one process at a time. No database runs."""

import fcntl
import json
import re
from pathlib import Path


def connect(path):
    return Connection(Path(path))


class Connection:
    def __init__(self, path):
        self.lock = open(path.with_suffix(".lock"), "w")
        fcntl.flock(self.lock, fcntl.LOCK_EX)
        self.path = path
        self.tables = json.loads(path.read_text()) if path.exists() else {}

    def cursor(self):
        return Cursor(self.tables)

    def commit(self):
        self.path.write_text(json.dumps(self.tables))

    def close(self):
        self.lock.close()


class Cursor:
    def __init__(self, tables):
        self.tables, self.found = tables, []

    def executemany(self, sql, rows):
        for row in rows:
            self.execute(sql, row)

    def execute(self, sql, values):
        if m := re.fullmatch(r"INSERT INTO (\w+) \(([^)]*)\) VALUES .*", sql):
            self.tables.setdefault(m[1], []).append(dict(zip(m[2].split(", "), values)))
        elif m := re.fullmatch(r"INSERT INTO (\w+) \(([^)]*)\) SELECT [^F]* FROM (\w+) WHERE token = \?", sql):
            names = m[2].split(", ")
            self.tables.setdefault(m[1], []).extend(
                {n: r[n] for n in names} for r in self.tables.get(m[3], []) if r["token"] == values[0])
        elif m := re.fullmatch(r"DELETE FROM (\w+) WHERE token = \?", sql):
            self.tables[m[1]] = [r for r in self.tables.get(m[1], []) if r["token"] != values[0]]
        elif m := re.fullmatch(r"SELECT 1 FROM (\w+) WHERE job = \? AND epoch = \?", sql):
            self.found = [r for r in self.tables.get(m[1], []) if (r["job"], r["epoch"]) == tuple(values)]
        else:
            raise AssertionError(sql)

    def fetchone(self):
        return self.found[0] if self.found else None
