"""Transit timetable analytics on Spark."""
