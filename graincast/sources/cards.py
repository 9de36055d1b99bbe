"""The dashboard as a Spark data source: tasks write pages of cards, and one commit makes them the dashboard.

Each task writes its rows in scripts of at most a page's rows into a draft folder. The commit moves the folder to its place and then
puts ``index.html``, which names the scripts in order and loads them as a reader asks for more: until then readers have the dashboard
of the run before, and a run that dies leaves that as it is. The driver holds the scripts' names and counts, never the cards.
"""

from __future__ import annotations

import html
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

PAGE_ROWS = 500
PAGE = """<!DOCTYPE html><meta charset=utf-8><title>{title}</title><h1>{title}</h1><p>{head}</p><input id=find><label><input id=due type=checkbox>마감순</label><ul id=list></ul><button id=more>+</button>
<script>const rows=[],files={files};let next=0;const put=()=>{{const q=find.value.trim().toLowerCase();list.innerHTML='';for(const r of rows.filter(r=>(r.company+r.title).toLowerCase().includes(q)).sort((a,b)=>due.checked?a.dsort-b.dsort||b.score-a.score:b.score-a.score||a.dsort-b.dsort)){{const e=document.createElement('li');e.textContent=[r.score+(r.hot?'🔥':''),r.verdict,r.deadline,r.company,r.title].join(' · ');list.append(e)}}more.hidden=next>=files.length}};const load=all=>{{if(next>=files.length)return put();const s=document.createElement('script');s.src=files[next++];s.onload=()=>all?load(all):put();document.body.append(s)}};find.oninput=due.onchange=()=>load(true);more.onclick=()=>load(false);load(false)</script>"""


def store_of(path: str):
    """The file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: its place among the tasks, its scripts in order, and counts of its cards."""

    place: int
    files: list[str]
    cards: int
    hot: int
    urgent: int


class CardPages(DataSource):
    """``df.write.format("card_pages")`` with ``path`` (an absolute path or URI), ``person`` and ``as_of``; rows are shown in the order of the tasks."""

    @classmethod
    def name(cls) -> str:
        return "card_pages"

    def writer(self, schema, overwrite: bool) -> CardWriter:
        return CardWriter(self.options["path"].rstrip("/"), self.options.get("person") or "", self.options.get("as_of") or "", int(self.options.get("page_rows", PAGE_ROWS)))


class CardWriter(DataSourceWriter):
    def __init__(self, path: str, person: str, as_of: str, page_rows: int):
        self.path, self.person, self.as_of, self.page_rows = path, person, as_of, page_rows
        self.folder = f"cards-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        task, told = TaskContext.get(), Written(0, [], 0, 0, 0)
        told.place = task.partitionId()
        store, root = store_of(self.path)
        held: list[dict] = []

        def put() -> None:
            name = f"{told.place}-{task.attemptNumber()}-{len(told.files)}.js"
            store.create_dir(f"{root}/.draft-{self.folder}", recursive=True)
            with store.open_output_stream(f"{root}/.draft-{self.folder}/{name}") as out:
                out.write(f"rows.push(...{json.dumps(held, ensure_ascii=False)})".encode("utf-8", "replace"))
            told.files.append(name)
            held.clear()

        for row in rows:
            held.append(row.asDict(recursive=True))
            told.cards += 1
            told.hot += bool(row["hot"])
            told.urgent += bool(row["urgent"])
            if len(held) == self.page_rows:
                put()
        if held:
            put()
        return told

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        done = sorted((m for m in messages if m is not None and m.files), key=lambda m: m.place)
        store, root = store_of(self.path)
        store.create_dir(root, recursive=True)
        files = [name for m in done for name in m.files]
        if files:
            draft = f"{root}/.draft-{self.folder}"
            for extra in {f.base_name for f in store.get_file_info(fs.FileSelector(draft))}.difference(files):
                store.delete_file(f"{draft}/{extra}")  # of attempts that didn't count
            store.move(draft, f"{root}/{self.folder}")
        head = f"{self.as_of} · {sum(m.cards for m in done)} · 🔥 {sum(m.hot for m in done)} · ⏰ {sum(m.urgent for m in done)}"
        page = PAGE.format(title=html.escape(self.person or "전체"), head=head, files=json.dumps([f"{self.folder}/{n}" for n in files]))
        with store.open_output_stream(f"{root}/index.html.draft") as out:
            out.write(page.encode())
        store.move(f"{root}/index.html.draft", f"{root}/index.html")
        for old in store.get_file_info(fs.FileSelector(root)):
            if old.base_name.startswith("cards-") and old.base_name != self.folder:
                store.delete_dir(old.path)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, root = store_of(self.path)
        draft = f"{root}/.draft-{self.folder}"
        if store.get_file_info([draft])[0].type != fs.FileType.NotFound:
            store.delete_dir(draft)


def write(spark: SparkSession, rows: DataFrame, path: str, person: str, as_of: str, page_rows: int = PAGE_ROWS) -> None:
    """Makes ``rows``, in their order, the dashboard in ``path``."""
    spark.dataSource.register(CardPages)
    rows.write.format("card_pages").mode("append").options(path=path, person=person, as_of=as_of, page_rows=str(page_rows)).save()
