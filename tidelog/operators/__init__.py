"""Runtime operators on stream tables: insert, deliver, retain, migrate."""
