"""Small feeds: the clean one, and how to vary it."""

import zipfile


def clean():
    return {
        "agency.txt": [{"agency_id": "a", "agency_name": "A", "agency_url": "https://example.com", "agency_timezone": "Europe/Helsinki"}],
        "stops.txt": [{"stop_id": "s1", "stop_name": "One", "stop_lat": "60.10", "stop_lon": "24.90"}, {"stop_id": "s2", "stop_name": "Two", "stop_lat": "60.20", "stop_lon": "25.00"}],
        "routes.txt": [{"route_id": "r", "agency_id": "a", "route_short_name": "1", "route_type": "3"}],
        "trips.txt": [{"route_id": "r", "service_id": "wk", "trip_id": "t"}],
        "stop_times.txt": [
            {"trip_id": "t", "arrival_time": "08:00:00", "departure_time": "08:00:00", "stop_id": "s1", "stop_sequence": "1"},
            {"trip_id": "t", "arrival_time": "08:10:00", "departure_time": "08:11:00", "stop_id": "s2", "stop_sequence": "2"},
        ],
        "calendar.txt": [{"service_id": "wk", "monday": "1", "tuesday": "1", "wednesday": "1", "thursday": "1", "friday": "1", "saturday": "0", "sunday": "0", "start_date": "20260101", "end_date": "20261231"}],
    }


def text(rows):
    columns = list(dict.fromkeys(c for r in rows for c in r))
    return "\n".join([",".join(columns), *[",".join(r.get(c, "") for c in columns) for r in rows]]) + "\n"


def write(path, tables, **raw):
    with zipfile.ZipFile(path, "w") as z:
        for name, rows in tables.items():
            z.writestr(name, text(rows))
        for name, data in raw.items():
            z.writestr(name, data)
    return str(path)
