"""The map: one self-contained page of a graph's nodes and edges (SC45, GR24 to GR26, XT14)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.operators import graph

MOST = 5000
PAGE = """<!doctype html><meta charset="utf-8"><title>map</title><svg id="m" viewBox="-60 -60 120 120" width="100%" height="95vh"></svg>
<script type="application/json" id="data">{data}</script>
<script>const d=JSON.parse(document.getElementById("data").textContent),s=document.getElementById("m"),n="http://www.w3.org/2000/svg",at={{}};
d.nodes.forEach(x=>at[x.node]=x);d.edges.forEach(e=>{{const a=at[e.src],b=at[e.dst];if(!a||!b)return;const l=document.createElementNS(n,"line");
l.setAttribute("x1",a.x);l.setAttribute("y1",a.y);l.setAttribute("x2",b.x);l.setAttribute("y2",b.y);l.setAttribute("stroke","#999");l.setAttribute("stroke-width",".1");s.append(l)}});
d.nodes.forEach(x=>{{const c=document.createElementNS(n,"circle");c.setAttribute("cx",x.x);c.setAttribute("cy",x.y);c.setAttribute("r",.4+Math.sqrt(x.degree)/8);
const t=document.createElementNS(n,"title");t.textContent=x.node;c.append(t);s.append(c)}})</script>"""


def payload(nodes: DataFrame, edges: DataFrame, most: int = MOST) -> dict:
    """The most connected nodes with their places and the edges between them; what a page can show, and how many were left out."""
    d = nodes.select("node").distinct().join(graph.degree(edges), "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))
    shown = d.orderBy(F.desc("degree"), "node").limit(most)
    placed = graph.seed_positions(shown).join(shown, "node")
    names = shown.select("node")
    kept = edges.select("src", "dst").distinct().join(names.toDF("src"), "src", "left_semi").join(names.toDF("dst"), "dst", "left_semi").orderBy("src", "dst").limit(10 * most)
    rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  bounded by ``most``
    found = rows(placed.orderBy("node"))
    return {"nodes": found, "edges": rows(kept), "left_out": max(0, d.count() - len(found))}


def page(data: dict) -> str:
    """SF46: the page, with JSON that cannot close its element."""
    text = json.dumps(data, sort_keys=True, default=str).replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")
    return PAGE.format(data=text)
