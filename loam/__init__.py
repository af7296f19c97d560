"""A keyed table kept as a change log and sorted runs, with DataFrame operators over both."""
