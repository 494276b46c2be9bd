"""chatmod — live-chat moderation analytics on Spark.

Subpackages: ``sources`` (topic / chat-page readers and decoders),
``functions`` (text cleaning, scoring, policy, display expressions),
``operators`` (metrics, merges, serving reductions, leaderboard changes),
``streaming`` (the streaming job, partial store, state-store leaderboards,
sinks) and ``plans`` (the registered queries over the driver tables and their
SQL). ``python -m chatmod`` starts the streaming pipeline.
"""

__version__ = "0.1.0"
