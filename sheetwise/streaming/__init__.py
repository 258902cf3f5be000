"""Structured Streaming forms of the intake and session operators.

Keyed state stays per name, session or transfer; anything global (the cap on sessions, unique names
against the catalogue) runs per micro-batch in ``foreachBatch``, where batches come one at a time.
A batch writes to a folder named after its id, so a repeated batch replaces itself.
"""
