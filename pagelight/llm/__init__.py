"""Operators for large text collections: cleaning, deduplication, labelling and mixing of document content.

Every operator takes frames with the entities of this library: ``doc_id`` (bigint) names a
document, ``content`` is its text, ``source`` where the text was extracted from, ``language``
its declared tag, ``status`` its review state.  Further columns are ignored.
"""
