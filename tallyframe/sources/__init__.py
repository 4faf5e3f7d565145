"""Readers and writers: text chunks, indexes, request lists, manifests, XML, JDBC."""
