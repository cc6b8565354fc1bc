"""Source files of the tests, made here."""

import io
import json
import zipfile
from xml.sax.saxutils import escape

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(paragraphs, table=()):
    p = lambda s: f"<w:p><w:r><w:t>{escape(s)}</w:t></w:r></w:p>"
    rows = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in row) + "</w:tr>" for row in table)
    body = "".join(map(p, paragraphs)) + (f"<w:tbl>{rows}</w:tbl>" if table else "")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document {W}><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def pdf(pages):
    parts = []
    for lines in pages:
        text = "BT /F1 12 Tf 72 720 Td " + " ".join(f"({s.replace('(', chr(92) + '(').replace(')', chr(92) + ')')}) Tj 0 -14 Td" for s in lines) + " ET"
        parts.append(f"1 0 obj\n<< /Length {len(text)} >>\nstream\n{text}\nendstream\nendobj\n")
    return b"%PDF-1.4\n" + "".join(parts).encode("cp1252") + b"%%EOF"


def people(folder):
    """Two people over five kinds of sources, a twin that shares a phone, and hostile files."""
    files = {
        "roster.csv": 'name,email,phone,current_company,title\nMira Solano,mira@solano.example,+1 415 555 2671,Kite Labs,Engineer\n"Solano, Mira",mira+jobs@solano.example,,Kite Labs,Sr. Engineer\nBad,row@x.example,1,a,b,EXTRA\nn/a,-,—,,\nTom Reed,tom@reed.example; not-mail,98765 43210 / 12,Reed & Co,Chef\n'.encode(),
        "latin.csv": "Name,Email\nJosé Peña,jose@pena.example\n".encode("cp1252"),
        "wide.csv": "name,email\nUlla Ström,ulla@strom.example\n".encode("utf-16"),
        "ats.json": json.dumps({"candidates": [
            {
                "candidateName": "Mira Solano", "emailAddress": "mira@solano.example", "phoneNumber": 4155552671, "currentEmployer": "Kite Labs", "designation": "Staff Engineer",
                "skills": "Python, Kubernetes , n/a", "workHistory": [{"org": "Kite Labs", "role": "Staff Engineer", "from": "2021-06", "to": "Present"}, {"org": "Nimbus", "role": "Dev", "from": "2018-02", "to": "2021-05"}, "x"],
                "schooling": [{"school": "Delft University", "degree": "MSc", "endYear": 2017}], "city": "Utrecht", "country": "Netherlands", "lastUpdated": "2026-05-14", "totalYearsExperience": 15,
                "profileUrls": ["https://github.com/mirasolano"],
            },
            {"candidateName": "Zed Zulu", "phoneNumber": "+1 415 555 2671"}, 7,
        ]}).encode(),
        "github_mira.json": json.dumps({"login": "mirasolano", "name": "Mira Solano", "bio": None, "languages": {"Go": 3, "TypeScript": 1}, "location": "Utrecht, NL"}).encode(),
        "linkedin_tom.json": json.dumps({"firstName": "Tom", "lastName": "Reed", "headline": "Chef", "publicProfileUrl": "www.linkedin.com/in/tomreed", "location": {"city": "Pune", "country": "India"}, "positions": [{"companyName": "Reed & Co", "title": "Chef", "startDate": {"year": 2020}, "isCurrent": True}], "educations": [{"schoolName": "Pune College", "endYear": "2012"}]}).encode(),
        "note_mira.txt": b"Name: Mira Solano\nRole: Engineer\nLocation: Utrecht, Netherlands\nmira@solano.example, +1 (415) 555-2671\nEngineer at Kite Labs since Jun 2021.\nSite https://mirasolano.dev and Python.\nKite Labs \xe2\x80\x94 Lead\n2016 - 2017\nMSc in Physics, Delft University, 2017\n",
        "note_two.txt": b"mira@solano.example and tom@reed.example spoke.",
        "resume_tom.docx": docx(["Tom Reed | Chef", "tom@reed.example"], [("Cooking", "Python")]),
        "resume_ulla.pdf": pdf([["Ulla Strom", "page head", "ulla@strom.example migra-"], ["tion work", "page head", "Go (daily)"]]),
        "broken.json": b'{"candidateName": "X', "fake.pdf": b"hello", "page.csv": b"<html></html>", "notes.md": b"x", "empty.txt": b"",
    }
    for name, blob in files.items():
        (folder / name).write_bytes(blob)
    return files
