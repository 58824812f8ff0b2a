"""The rate tables kept up to date over a folder that receives new log files."""
