"""gridloom: unit x month panel analytics on Spark."""
