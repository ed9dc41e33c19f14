"""The page pipeline, the detector dataset plan, and the registered queries."""
