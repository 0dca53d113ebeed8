"""DataFrame -> DataFrame operators, composed with ``df.transform``.

Layout: ``ticks`` (one row per price tick) is built by ``ticks``/``enrich``/
``pricing``; ``zones`` makes a row per tick and zone of it, with the zone's
series (scenario x strike case) side by side, and runs the windows of one
quarter hour; ``carries`` scans what quarter hours hand on to each other;
``dispatch``/``constraints`` put both together for each tick; ``series`` is the
long table, one row per tick and series; ``reports`` aggregates.
"""
